"""Binary match tables as a Python data source, and a writer.

Layout: flags u16, n_seqs u64, n_rows u64, lengths u32[n] (u16 without the length flag), starts i64[n, N] (-1: absent),
strand bits [n * N] (most significant bit first), then, with the block flag, num_blocks u64 and u32 pairs (s, e).
Rows are read in chunks that are multiples of 8, so every chunk's strand bits begin on a byte; each chunk is a partition
and reads three ranges of the file. A filter on mum_id prunes chunks before anything is read; the option ``ranges`` names
several row ranges, of which only the chunks they touch are read, and no other row is given.

Paths must be readable by the executors (a shared file system), or start with http:// or https://: then each read is a
request for a byte range, and a server that does not know ranges is an error.
"""

from __future__ import annotations

import os
import struct
import tempfile
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, EqualTo, InputPartition, LessThan, LessThanOrEqual

# The flag bits of the writer here.
LENGTH32, BLOCKS = 1, 2
CHUNK_ROWS = 1 << 16
SCHEMA = "mum_id bigint, seq_idx int, start bigint, length bigint, strand boolean"


@dataclass
class Header:
    flags: int
    n_seqs: int
    n_rows: int
    num_blocks: int | None

    @property
    def width(self) -> int:
        return 4 if self.flags & LENGTH32 else 2

    @property
    def starts_at(self) -> int:
        return 18 + self.n_rows * self.width

    @property
    def strands_at(self) -> int:
        return self.starts_at + self.n_rows * self.n_seqs * 8

    @property
    def blocks_at(self) -> int:
        return self.strands_at + -(-self.n_rows * self.n_seqs // 8)


def is_url(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def read_at(path: str, offset: int, size: int) -> bytes:
    """``size`` bytes from ``offset`` of a file or of what a server holds; fewer are an error."""
    if not size:
        return b""
    if is_url(path):
        ask = urllib.request.Request(path, headers={"Range": f"bytes={offset}-{offset + size - 1}"})
        with urllib.request.urlopen(ask) as answer:  # an HTTP error is an OSError
            if answer.status != 206:
                raise ValueError(f"{path}: the server does not answer byte ranges")
            data = answer.read(size + 1)
    else:
        with open(path, "rb") as f:
            f.seek(offset)
            data = f.read(size)
    if len(data) != size:
        raise ValueError(f"{path}: {size} bytes wanted at {offset}, {len(data)} read")
    return data


def size_of(path: str) -> int:
    if not is_url(path):
        return os.path.getsize(path)
    with urllib.request.urlopen(urllib.request.Request(path, headers={"Range": "bytes=0-0"})) as answer:
        total = (answer.headers.get("Content-Range") or "").rpartition("/")[2]
    if not total.isdigit():
        raise ValueError(f"{path}: the server does not tell the size")
    return int(total)


def read_header(path: str) -> Header:
    h = Header(*struct.unpack("<HQQ", read_at(path, 0, 18)), None)
    if h.flags & BLOCKS:
        h.num_blocks = struct.unpack("<Q", read_at(path, h.blocks_at, 8))[0]
    return h


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """s, e: the stored inclusive blocks (none if the file has none)."""
    h, pairs = read_header(path), np.zeros((0, 2), np.int64)
    if h.num_blocks:
        pairs = np.frombuffer(read_at(path, h.blocks_at + 8, h.num_blocks * 8), "<u4").reshape(-1, 2).astype(np.int64)
    return spark.createDataFrame(pa.table({"s": pairs[:, 0], "e": pairs[:, 1]}))


@dataclass
class _Rows(InputPartition):
    lo: int
    hi: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int, ranges: list[tuple[int, int]] | None = None):
        self.path, self.rows, self.ranges, self.least, self.most = path, rows, ranges, 0, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if getattr(f, "attribute", None) == ("mum_id",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.least = max(self.least, f.value)
                if isinstance(f, GreaterThan):
                    self.least = max(self.least, f.value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.most = f.value if self.most is None else min(self.most, f.value)
                if isinstance(f, LessThan):
                    self.most = f.value - 1 if self.most is None else min(self.most, f.value - 1)
            yield f  # chunks are pruned; Spark still filters rows

    def partitions(self):
        n = read_header(self.path).n_rows
        end = n if self.most is None else min(n, self.most + 1)
        first = max(0, self.least) // self.rows * self.rows
        chunks = [_Rows(lo, min(lo + self.rows, n)) for lo in range(first, max(end, 0), self.rows)]
        if self.ranges is not None:
            chunks = [c for c in chunks if any(lo < c.hi and c.lo < hi for lo, hi in self.ranges)]
        return chunks or [_Rows(0, 0)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        yield read_rows(self.path, part.lo, part.hi, self.ranges)


def read_rows(path: str, lo: int, hi: int, ranges: list[tuple[int, int]] | None = None) -> pa.RecordBatch:
    """Rows ``lo`` (a multiple of 8) to ``hi`` of a match file, all genomes, by three byte ranges; of ``ranges`` only, if given."""
    h, n = read_header(path), hi - lo
    length = np.frombuffer(read_at(path, 18 + lo * h.width, n * h.width), f"<u{h.width}").astype(np.int64)
    start = np.frombuffer(read_at(path, h.starts_at + lo * h.n_seqs * 8, n * h.n_seqs * 8), "<i8")
    bits = read_at(path, h.strands_at + lo * h.n_seqs // 8, -(-n * h.n_seqs // 8))
    strand = np.unpackbits(np.frombuffer(bits, np.uint8))[: n * h.n_seqs].astype(bool)
    row = np.arange(lo, hi)
    keep = np.ones(n, bool) if ranges is None else np.logical_or.reduce([(row >= a) & (row < b) for a, b in ranges] or [np.zeros(n, bool)])
    cells = np.repeat(keep, h.n_seqs)
    mum, seq = np.repeat(row, h.n_seqs), np.tile(np.arange(h.n_seqs, dtype=np.int32), n)
    columns = (mum, seq, start, np.repeat(length, h.n_seqs), strand)
    return pa.RecordBatch.from_arrays([pa.array(c[cells]) for c in columns], names=["mum_id", "seq_idx", "start", "length", "strand"])


def read_chunks(chunks: DataFrame, path: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows of the chunks (``chunk``: number, of ``rows`` rows each, a multiple of 8) of a match file; no others are read."""
    total = read_header(path).n_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0).to_pylist():
                if c * rows < total:
                    yield read_rows(path, c * rows, min((c + 1) * rows, total))

    return chunks.select(chunks["chunk"].cast("bigint")).mapInArrow(run, SCHEMA)


def _ranges(text: str | None) -> list[tuple[int, int]] | None:
    """Half-open row ranges from ``lo-hi,lo-hi``; empty ones are left out."""
    if text is None:
        return None
    pairs = [tuple(map(int, x.split("-"))) for x in text.split(",") if x]
    return [(lo, hi) for lo, hi in pairs if lo < hi]


class MatchFile(DataSource):
    """``spark.read.format("matchfile").load(path)``; option ``rows`` sets the chunk size (a multiple of 8),
    ``ranges`` the rows to read (``lo-hi,lo-hi``, half-open)."""

    @classmethod
    def name(cls) -> str:
        return "matchfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        rows = int(self.options.get("rows", CHUNK_ROWS))
        if rows <= 0 or rows % 8:
            raise ValueError("rows must be a positive multiple of 8")
        return _Reader(self.options["path"], rows, _ranges(self.options.get("ranges")))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MatchFile)


def write(table: DataFrame, path: str, blocks: list[tuple[int, int]] | None = None, rows: int = CHUNK_ROWS) -> None:
    """Write a long match table (dense mum_id, every genome present) as one file, replaced in one step.

    Chunks of ``rows`` matches (a multiple of 8) are dealt to tasks, and each task writes its own byte ranges into a file
    beside the target, which all executors must see; a task that runs twice writes the same bytes twice. The driver
    writes the header and the blocks only, and renames the file once all tasks are done.
    """
    n, n_seqs = table.agg(F.max("mum_id"), F.max("seq_idx")).first()
    n, n_seqs = (0 if x is None else x + 1 for x in (n, n_seqs))
    h = Header(LENGTH32 | (BLOCKS if blocks is not None else 0), n_seqs, n, None)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> int:
            t = pa.Table.from_batches(held)
            lo = t.column("chunk")[0].as_py() * rows
            mine = min(rows, n - lo)
            if len(t) != mine * n_seqs or (t.column("mum_id").to_numpy() != np.repeat(np.arange(lo, lo + mine), n_seqs)).any():
                raise ValueError(f"rows {lo} to {lo + mine} need one match for each of {n_seqs} genomes")
            with open(temp, "r+b") as f:
                for at, data in (
                    (18 + lo * 4, t.column("length").to_numpy()[::n_seqs].astype("<u4")),
                    (h.starts_at + lo * n_seqs * 8, t.column("start").to_numpy().astype("<i8")),
                    (h.strands_at + lo * n_seqs // 8, np.packbits(t.column("strand").to_numpy(zero_copy_only=False))),
                ):
                    f.seek(at)
                    f.write(data.tobytes())
            held.clear()
            return mine

        done = 0
        for b in batches:
            c = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(b)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j:
                    if held and held[0].column(0)[0].as_py() != c[i]:
                        done += flush()
                    held.append(b.slice(i, j - i))
        if held:
            done += flush()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["done"])

    try:
        with os.fdopen(fd, "wb") as f:
            f.write(struct.pack("<HQQ", h.flags, n_seqs, n))
            f.truncate(h.blocks_at)
            if blocks is not None:
                f.seek(h.blocks_at)
                f.write(struct.pack("<Q", len(blocks)) + np.array(blocks, "<u4").tobytes())
        os.chmod(temp, 0o666 & ~_umask())
        dealt = table.select(F.floor(F.col("mum_id") / rows).cast("bigint").alias("chunk"), "mum_id", "seq_idx", "start", "length", "strand")
        dealt = dealt.repartition(max(1, min(-(-n // rows), 10_000)), "chunk").sortWithinPartitions("chunk", "mum_id", "seq_idx")
        done = dealt.mapInArrow(run, "done bigint").agg(F.sum("done")).first()[0] or 0
        if done != n:
            raise ValueError(f"{done} of {n} rows")
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def _umask() -> int:
    mask = os.umask(0)
    os.umask(mask)
    return mask
