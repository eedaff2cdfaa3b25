"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import Scratch
from .common import cut

#: Up to so many edges (16 bytes each) are joined in one task; more go through the distributed rounds.
ONE_TASK = 1_000_000


def _sum(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (a, b) and the least node of its piece."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(names))
    while len(names):
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return names, names[root]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`forest` of all edges of one partition."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        v, c = forest(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(c)], names=["v", "c"])


def components(edges: DataFrame) -> DataFrame:
    """(v, c): every node of ``edges`` (a, b bigint, any direction) and the smallest node it is connected with.

    Each round is two aggregations with map-side combining and two joins; rounds grow with the logarithm of the longest
    path. Nodes without edges are absent. An empty table gives an empty one.
    A table of at most ONE_TASK edges is closed in a single task instead, which gives the same rows.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _sum(e)
    if not before[0]:
        return e.select(F.col("a").alias("v"), F.col("b").alias("c"))
    if before[0] <= ONE_TASK:
        return cut(e.coalesce(1).mapInArrow(_forest, "v bigint, c bigint"))
    scratch = Scratch(e.sparkSession)  # rounds of joins: their tables are read again with their true sizes
    try:
        while True:
            # large star: each node links its larger neighbours to its smallest one (or itself)
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            # small star: each node links itself and its smaller neighbours to the smallest of them
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            e = scratch.keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
            after = _sum(e)
            if after == before:
                return cut(e.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(e.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct()))
            before = after
    finally:
        scratch.close()
