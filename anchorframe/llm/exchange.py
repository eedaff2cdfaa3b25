"""Packed messages between chunks of documents and partitioned tables.

A chunk asks many partitions, one row for each: a row is a few arrays as one compressed value. Equal questions of a chunk
are asked once, with their number, so nothing that is frequent in the corpus makes a partition large.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import textkit as tk


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one value: bytes of equal significance stand together, without leading zeros, each run compressed."""
    z, head, body = zstandard.ZstdCompressor(level=1), [], []
    for a in arrays:
        b = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
        wide = a.itemsize
        while wide > 1 and a.dtype.kind in "iu" and not b[:, wide - 1].any():
            wide -= 1
        planes = [np.ascontiguousarray(b[:, k]).tobytes() for k in range(wide)]
        planes = [min(p, z.compress(p), key=len) if len(p) > 64 else p for p in planes]
        head += [len(a), wide, *map(len, planes)]
        body += planes
    numbers = np.array(head, "<u4")
    return len(numbers).to_bytes(4, "little") + numbers.tobytes() + b"".join(body)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    z, out = zstandard.ZstdDecompressor(), []
    n = int.from_bytes(blob[:4], "little")
    head, at = iter(np.frombuffer(blob[4 : 4 + 4 * n], "<u4").tolist()), 4 + 4 * n
    for t in map(np.dtype, types):
        size, wide = next(head), next(head)
        b = np.zeros((size, t.itemsize), np.uint8)
        for k in range(wide):
            m = next(head)
            p = blob[at : at + m]
            b[:, k] = np.frombuffer(p if m == size else z.decompress(p), np.uint8)
            at += m
        out.append(b.reshape(-1).view(t))
    return out


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    return (tk.mix(x) % np.uint64(parts)).astype(np.int64)


def runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of the runs of equal values."""
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(x[a]), int(a), int(b)


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches, grouped by their first column: (value, iterator of rows)."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, itemgetter(0))


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def distinct(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (part, a, b) in order, how often each occurs, and the place of every entry among them."""
    order = np.lexsort((b, a, part))
    p, x, y = part[order], a[order], b[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.empty(len(p), np.int64)
    at[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return p[first], x[first], y[first], np.diff(np.append(first, len(p))), at


def beside(placed: DataFrame, more: DataFrame, n: int, key: str) -> DataFrame:
    """Both tables' rows, by ``key`` in ``n`` partitions; ``placed`` is dealt so already and stays where it is.

    Spark's union joins such tables partition by partition; where that is switched off, all rows are dealt again.
    """
    out = placed.unionByName(more.repartition(n, key))
    return out if placed.sparkSession.conf.get("spark.sql.unionOutputPartitioning", "false") == "true" else out.repartition(n, key)
