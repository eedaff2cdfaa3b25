"""Random access into FASTA files: a table of offsets, made by tasks that read byte ranges, and slices read by byte range.

A part is what one byte range holds of one record. Within it lines are of one length (or the part is marked ragged), so the
place of a letter is arithmetic; which letters of its record a part holds follows from running sums over the parts. So
neither a record nor a file need fit into a task, whether lines are 60 letters or a whole chromosome long.

Slices meet the parts they touch by a join and read the bytes between their first and last letter, and no others; a ragged
part is read whole. Paths are what :func:`matchfile.read_at` reads: files all executors see, or byte ranges over HTTP.
Files that are compressed have no places to jump to; :func:`fasta.read_fasta` reads them whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar
from ..functions.ordered import running_sum, shared
from .matchfile import is_url, read_at, size_of

#: Bytes of a range, and bytes within which a header line must end.
PART, HEADER = 8 << 20, 1 << 16
PARTS = "path string, name string, byte_from bigint, bytes bigint, letters bigint, first bigint, line bigint, width bigint"
#: Letters of a bin in which slices and parts meet.
BIN = 1 << 20


def _plain(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:") if path.startswith("file:/") else path


def _part(data: np.ndarray) -> tuple[int, int, int, int]:
    """(letters, letters before the first line end, letters of a line, bytes of a line) of some bytes of a record; no bytes of a
    line if its lines differ or blanks stand in them."""
    ends = np.flatnonzero(data == 10)
    blank = data <= 32
    letters = int(len(data) - blank.sum())
    if not len(ends):
        return letters, letters, 0, 0 if blank.any() else len(data) + 1
    back = int(ends[0] > 0 and data[ends[0] - 1] == 13)  # line ends of two bytes
    gaps = np.diff(ends)
    width = int(gaps[0]) if len(gaps) else len(data) - int(ends[0]) + back
    whole = blank.sum() == len(ends) * (1 + back) and (not back or (data[np.maximum(ends - 1, 0)] == 13).all())
    short_last = len(gaps) and gaps[-1] < width
    even = (gaps[:-1] == width).all() and (not len(gaps) or gaps[-1] <= width) and not (short_last and ends[-1] + 1 < len(data)) and len(data) - ends[-1] <= width
    return letters, int(ends[0]) - back, width - 1 - back, width if whole and even and width > 1 + back else 0


def scan(path: str, lo: int, hi: int, size: int) -> Iterator[tuple]:
    """The parts (PARTS) in the bytes ``lo`` to ``hi`` of a file; the name is null where a record goes on from before."""
    back, ahead = max(0, lo - HEADER), min(size, hi + HEADER)
    raw = read_at(_plain(path), back, ahead - back)
    at = lo - back
    start = raw.rfind(b"\n", 0, at) + 1
    if (start > 0 or back == 0) and raw[start : start + 1] == b">" and start < at:  # within a header
        end = raw.find(b"\n", at)
        at = len(raw) if end < 0 else end + 1
    name, stop = None, hi - back
    data = np.frombuffer(raw, np.uint8)
    heads = np.flatnonzero(data[at:stop] == ord(">")) + at
    heads = [int(h) for h in heads if h == 0 and back == 0 or h > 0 and raw[h - 1] == 10]
    for h in [*heads, None]:
        upto = stop if h is None else h
        if upto > at or name is not None:
            yield (path, name, back + at, max(upto - at, 0), *_part(data[at : max(upto, at)]))
        if h is not None:
            end = raw.find(b"\n", h)
            if end < 0 and ahead < size:
                raise ValueError(f"{path}: header at {back + h} has no end within {HEADER} bytes")
            words = raw[h + 1 : len(raw) if end < 0 else end].split()
            name, at = (words[0].decode() if words else ""), len(raw) if end < 0 else end + 1


def index(spark: SparkSession, paths: list[str], part: int = PART) -> DataFrame:
    """path, contig, record, byte_from, bytes, letter_from, letters, first, line, width of every part of the files' records."""
    sizes = [(p, size_of(_plain(p))) for p in paths]
    ranges = spark.createDataFrame([s for s in sizes if s[1]], "path string, size bigint")
    ranges = ranges.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(part).cast("bigint"))).alias("lo"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, lo in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = list(scan(path, lo, min(lo + part, size), size))
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=[x.split()[0] for x in PARTS.split(", ")])

    n = max(1, min(sum(-(-s // part) for _, s in sizes), 10_000))
    parts = shared(ranges.repartition(n, "path", "lo").mapInArrow(run, PARTS))
    wide = 1 << 40
    opens = parts.withColumn("goes_on", F.col("name").isNull())  # a header's part comes before one that starts where it ends
    numbered = running_sum(opens, ["path"], ["byte_from", "goes_on"], F.col("name").isNotNull().cast("int"), "record", wide).where("record > 0")
    names = numbered.where("name is not null").select("path", "record", F.col("name").alias("contig"))
    first = names.groupBy("path", "contig").agg(F.min("record").alias("record"))  # of records of one name, the first
    kept = numbered.drop("name", "goes_on").join(first, ["path", "record"])
    upto = running_sum(kept, ["path", "record"], ["byte_from"], F.col("letters"), "upto", wide)
    return shared(upto.select("path", "contig", "record", "byte_from", "bytes", (F.col("upto") - F.col("letters")).alias("letter_from"), "letters", "first", "line", "width"))


def fai_of(index_rows: DataFrame) -> DataFrame:
    """path, contig, record, length, offset, line, width: one row for each record; width 0 where its lines differ.

    Each record's first line is read; that the others are as long follows from how many letters every part holds.
    """
    records = index_rows.groupBy("path", "contig", "record").agg(F.sum("letters").alias("length"), F.min("byte_from").alias("offset"), F.sum("bytes").alias("total"))

    def first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, widths = [], []
            for path, length, offset, total in zip(*(b.column(x).to_pylist() for x in ("path", "length", "offset", "total")), strict=True):
                size, raw = 1 << 10, b""
                while b"\n" not in raw and len(raw) < total:
                    raw, size = read_at(_plain(path), offset, min(size, total)), size * 8
                line, end, _ = raw.partition(b"\n")
                lines.append(len(line.rstrip(b"\r")) or length)
                widths.append(len(line) + 1 if line else length + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lines, pa.int64()), pa.array(widths, pa.int64())], names=[*b.schema.names, "line", "width"])

    seen = records.mapInArrow(first_line, "path string, contig string, record bigint, length bigint, offset bigint, total bigint, line bigint, width bigint")
    upto = lambda x: F.when(F.col("line") > 0, F.least(F.floor(x / F.col("width")) * F.col("line") + F.least(x % F.col("width"), F.col("line")), F.col("length"))).otherwise(0)
    own = index_rows.select("path", "record", "byte_from", "bytes", "letters", F.col("width").alias("w")).join(seen, ["path", "record"])
    at = F.col("byte_from") - F.col("offset")
    odd = (upto(at + F.col("bytes")) - upto(at) != F.col("letters")) | ((F.col("w") == 0) & (F.col("bytes") > 2 * F.col("width")))
    out = own.groupBy("path", "contig", "record", "length", "offset", "line", "width").agg(F.bool_or(odd).alias("odd"))
    return out.select("path", "contig", "record", "length", "offset", "line", F.when(F.col("odd"), 0).otherwise(F.col("width")).alias("width"))


def write_fai(index_rows: DataFrame, path: str) -> None:
    """Offset file of one FASTA file: name, length, offset, letters and bytes of a line, tab-separated, in order (a row for
    each record, written on the driver). Records whose lines differ are an error."""
    rows = fai_of(index_rows).orderBy("record").collect()  # a row for each record
    bad = [r.contig for r in rows if not r.width]
    if bad:
        raise ValueError(f"lines of different lengths: {', '.join(bad[:5])}")
    with open(_plain(path), "w") as f:
        f.writelines(f"{r.contig}\t{r.length}\t{r.offset}\t{r.line}\t{r.width}\n" for r in rows)


def read_fai(spark: SparkSession, fasta: str, path: str | None = None) -> DataFrame:
    """The rows of :func:`index` from an offset file (``fasta``.fai): a part for each record."""
    lines = spark.read.csv(path or f"{fasta}.fai", sep="\t", schema="contig string, letters bigint, byte_from bigint, line bigint, width bigint", mode="FAILFAST")
    lines = lines.withColumn("record", F.monotonically_increasing_id() + 1)
    size = F.col("letters") + F.when(F.col("line") > 0, F.expr("(letters - 1) div line") * (F.col("width") - F.col("line"))).otherwise(0)
    return lines.select(F.lit(fasta).alias("path"), "contig", "record", "byte_from", size.alias("bytes"), F.lit(0).cast("bigint").alias("letter_from"), "letters", F.least("line", "letters").alias("first"), "line", "width")


def offsets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The index of files: of those with an offset file beside them, from it."""
    ready = [p for p in paths if not is_url(p) and os.path.exists(f"{_plain(p)}.fai")]
    tables = [read_fai(spark, p) for p in ready]
    if len(ready) < len(paths):
        tables.append(index(spark, [p for p in paths if p not in ready]))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _bytes(first: int, line: int, width: int, lo: int, hi: int) -> tuple[int, int]:
    """Bytes within a part that hold its letters ``lo`` to ``hi``."""
    place = lambda x: x if x < first or line <= 0 else width_of_first + (x - first) // line * width + (x - first) % line
    width_of_first = first + width - line
    return place(lo), place(hi - 1) + 1


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row = b.column(0)
        out, read = [], []
        for path, byte_from, size, first, line, width, lo, hi in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
            if path is None or hi <= lo:
                out.append("")
                read.append(0)
                continue
            p, q = _bytes(first, line, width, lo, hi) if width else (0, size)
            data = b"".join(read_at(_plain(path), byte_from + p, q - p).split())
            out.append((data if width else data[lo:hi]).decode())
            read.append(q - p)
        yield pa.RecordBatch.from_arrays([row, b.column(1), pa.array(out, pa.string()), pa.array(read, pa.int64())], names=["_row", "_at", "_seq", "_read"])


def fetch(bed: DataFrame, index_rows: DataFrame) -> DataFrame:
    """All columns of ``bed`` (path, contig, start, end, ..) with ``header``, ``slice`` and ``bytes_read``.

    Rows as those of :func:`seqs.fetch_pieces`: a contig that does not exist and what begins behind its end give empty
    slices, and rows that agree in all columns are given once.
    """
    row = F.struct(*bed.columns)
    last = F.greatest(F.col("start"), F.col("end") - 1)
    bins = lambda a, b: F.sequence(F.floor(a / BIN).cast("bigint"), F.floor(b / BIN).cast("bigint"))
    asked = bed.distinct().select(row.alias("_row"), F.col("path").alias("_p"), F.col("contig").alias("_c"), "start", "end", F.explode(bins(F.col("start"), last)).alias("_bin"))
    ends = F.col("letter_from") + F.col("letters")
    parts = index_rows.where("letters > 0").select("*", F.explode(bins(F.col("letter_from"), ends - 1)).alias("bin"))
    first_bin = F.greatest(F.floor(F.col("start") / BIN), F.floor(F.col("letter_from") / BIN))
    meet = (F.col("_p") == F.col("path")) & (F.col("_c") == F.col("contig")) & (F.col("_bin") == F.col("bin")) & (F.col("bin") == first_bin) & (F.col("letter_from") < F.col("end")) & (ends > F.col("start"))
    j = asked.join(parts, meet, "left")
    lo = F.greatest(F.col("start") - F.col("letter_from"), F.lit(0))
    hi = F.least(F.col("end") - F.col("letter_from"), F.col("letters"))
    want = j.select("_row", F.coalesce("letter_from", F.lit(-1)).alias("_at"), "path", "byte_from", "bytes", "first", "line", "width", lo.alias("lo"), hi.alias("hi"))
    got = want.sortWithinPartitions("path", "byte_from").mapInArrow(_read, _schema(want, bed))
    whole = got.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_seq"))).alias("ps"), F.sum("_read").alias("bytes_read"))
    text = F.array_join(F.transform("ps", lambda p: p["_seq"]), "")
    return whole.select("_row.*", scalar.fasta_header(F.col("_row.contig"), F.col("_row.start"), F.col("_row.end")).alias("header"), text.alias("slice"), "bytes_read")


def _schema(want: DataFrame, bed: DataFrame):
    return f"_row {want.schema['_row'].dataType.simpleString()}, _at bigint, _seq string, _read bigint"


def sequences(index_rows: DataFrame) -> DataFrame:
    """path, contig, at, seq: all letters, a row for each part (see :func:`suffix_order.unique_matches`)."""
    want = index_rows.where("letters > 0").select(F.struct("path", "contig").alias("_row"), F.col("letter_from").alias("_at"), "path", "byte_from", "bytes", "first", "line", "width", F.lit(0).cast("bigint").alias("lo"), F.col("letters").alias("hi"))
    return want.mapInArrow(_read, _schema(want, want)).select("_row.path", "_row.contig", F.col("_at").alias("at"), F.col("_seq").alias("seq"))


def missing(bed: DataFrame, index_rows: DataFrame) -> DataFrame:
    """path, contig of rows whose sequence no file has."""
    return bed.select("path", "contig").distinct().join(index_rows.select("path", "contig").distinct(), ["path", "contig"], "left_anti")
