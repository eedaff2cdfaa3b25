"""Order-dependent helpers that never sort a whole key into one task.

Rows are cut into blocks of ``width`` positions of their (numeric) order column. Windows run within blocks; one row for
each block is enough to carry a neighbour, a running total or a last seen value across block bounds, and only those rows
are windowed by key alone.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

WIDTH = 1 << 20


#: Tables of up to this many rows are broadcast; larger ones are joined by shuffle, with the same rows.
BROADCAST_ROWS = 100_000


def shared(df: DataFrame) -> DataFrame:
    """``df``, written once to the checkpoint folder, because several branches of a plan read it.

    Nothing stays in memory, and plans that are built on it start anew, so they stay short. The folder is the session's
    ``spark.checkpoint.dir``, which driver and executors must share; a local master without one uses a temporary folder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local master without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


class Scratch:
    """Tables of an operator that works in rounds, as files in a folder of their own beside the session's checkpoints.

    Unlike a checkpoint, a table read again has the size of its files and not the product of all sizes it was joined from,
    which after a dozen rounds takes the planner longer than the work. ``close`` deletes the folder; what is still
    needed then must have been checkpointed.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def local(self) -> str:
        """The folder as a path of the file system that driver and executors share, for files that Spark does not write."""
        path = re.sub(r"^file:/*(?=/)", "", self.folder)
        if "://" in path:
            raise ValueError(f"{self.folder} is no folder of a shared file system")
        os.makedirs(path, exist_ok=True)
        return path

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether ``df`` has at most ``rows`` rows (BROADCAST_ROWS)."""
    rows = BROADCAST_ROWS if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def fitting(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it is small."""
    return F.broadcast(df) if small(df) else df


def _block(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


def with_next(df: DataFrame, keys: list[str], order: list[str], value: list[str], name: str = "next", width: int = WIDTH) -> DataFrame:
    """``df`` with the struct ``name`` of the columns ``value`` of the next row of its key by ``order`` (null at the end)."""
    own = df.withColumn("_blk", _block(order[0], width)).withColumn("_val", F.struct(*value))
    heads = own.groupBy(*keys, "_blk").agg(F.min_by("_val", F.struct(*order)).alias("_head"))
    carry = heads.withColumn("_carry", F.lead("_head").over(W.partitionBy(*keys).orderBy("_blk") if keys else W.orderBy("_blk"))).drop("_head")
    inner = F.lead("_val").over(W.partitionBy(*keys, "_blk").orderBy(*order))
    # the rows lie in the order of a merge join already; without the hint those of a table of some MB are broadcast
    return own.withColumn("_in", inner).join(carry.hint("merge"), [*keys, "_blk"]).withColumn(name, F.coalesce("_in", "_carry")).drop("_blk", "_val", "_in", "_carry")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the sum of ``value`` over its key's rows up to and including this one, by ``order``."""
    own = df.withColumn("_blk", _block(order[0], width)).withColumn("_val", value.cast("bigint"))
    totals = own.groupBy(*keys, "_blk").agg(F.sum("_val").alias("_t"))
    before = (W.partitionBy(*keys).orderBy("_blk") if keys else W.orderBy("_blk")).rowsBetween(W.unboundedPreceding, -1)
    base = totals.withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inner = F.sum("_val").over(W.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return own.withColumn("_in", inner).join(base.hint("merge"), [*keys, "_blk"]).withColumn(name, F.col("_in") + F.col("_base")).drop("_blk", "_val", "_in", "_base")


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the number (from 0) of each row within its key by ``order``."""
    return running_sum(df, keys, order, F.lit(1), name, width).withColumn(name, F.col(name) - 1)


#: Position blocks in which :func:`asof` looks for candidates.
FINE = 1 << 14


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, order: list[str], value: list[str], name: str, width: int = WIDTH, fine: int = FINE) -> DataFrame:
    """``left`` with the struct ``name`` of ``value`` of the last row of ``right`` whose order[0] is at most ``at``.

    Ties in order[0] go to the last by the rest of ``order``. The distinct points of ``left`` meet the rows of their own
    fine block and the one before, which nearly always hold the answer, so of the right side only those blocks go on.
    Points for which they are empty look further, among the last rows of all blocks.
    """
    fine = min(fine, width)
    r = right.select(*keys, F.col(order[0]).cast("bigint").alias("_at"), F.struct(*order).alias("_o"), F.struct(*value).alias("_v")).withColumn("_fine", _block("_at", fine))
    points = shared(left.select(*keys, F.col(at).cast("bigint").alias("_p")).distinct())
    few = small(points)
    around = points.withColumn("_fine", F.explode(F.array(_block("_p", fine), _block("_p", fine) - 1)))
    near = r.join(F.broadcast(around) if few else around, [*keys, "_fine"]).where("_at <= _p")
    found = shared(near.groupBy(*keys, "_p").agg(F.max_by("_v", "_o").alias(name)))
    lost = points.join(F.broadcast(found) if few else found, [*keys, "_p"], "left_anti")
    if not lost.isEmpty():  # points before a key's first row have no answer anywhere
        first = r.groupBy(*keys).agg(F.min("_at").alias("_first"))
        lost = shared((lost.join(first, keys) if keys else lost.join(F.broadcast(first))).where("_first <= _p").drop("_first"))
    if not lost.isEmpty():
        lasts = r.groupBy(*keys, "_fine").agg(F.max_by(F.struct("_at", "_o", "_v"), "_o").alias("_x")).select(*keys, "_x._at", "_x._o", "_x._v")
        far = _asof_lasts(lost.withColumn("_at", F.col("_p")), lasts, keys, width)
        found = found.unionByName(shared(far.select(*keys, "_p", F.col("_far").alias(name))))
    found = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_p", name)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(at).cast("bigint").eqNullSafe(F.col("_p"))]
    return left.join(F.broadcast(found) if few else found, same, "left").select(*left.columns, name)


def _asof_lasts(points: DataFrame, rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``points`` (keys, _p, _at) with ``_far``, the _v of the last of ``rows`` (keys, _at, _o, _v) at or before _at.

    Both sides are dealt by key and block; blocks without rows on the right side take the last row of an earlier block.
    """
    r, q = rows.withColumn("_blk", _block("_at", width)), points.withColumn("_blk", _block("_at", width))
    lasts = r.groupBy(*keys, "_blk").agg(F.max_by("_v", "_o").alias("_last"))
    blocks = q.select(*keys, "_blk").distinct().join(lasts, [*keys, "_blk"], "full")
    before = (W.partitionBy(*keys).orderBy("_blk") if keys else W.orderBy("_blk")).rowsBetween(W.unboundedPreceding, -1)
    carry = blocks.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    events = r.select(*keys, "_blk", "_at", F.lit(0).alias("_kind"), "_o", "_v", none(q, "_p")).unionByName(q.select(*keys, "_blk", "_at", F.lit(1).alias("_kind"), none(r, "_o"), none(r, "_v"), "_p"))
    w = W.partitionBy(*keys, "_blk").orderBy("_at", "_kind", "_o").rowsBetween(W.unboundedPreceding, 0)
    got = events.withColumn("_in", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1").join(carry, [*keys, "_blk"])
    return got.select(*keys, "_p", F.coalesce("_in", "_carry").alias("_far"))


def asof_next(left: DataFrame, right: DataFrame, keys: list[str], at: str, order: list[str], value: list[str], name: str, width: int = WIDTH, fine: int = FINE) -> DataFrame:
    """Like :func:`asof` for the first row whose order[0] is at least ``at``; ties go to the first by ``order``."""
    mirrored = right.select("*", *[(-F.col(o)).alias(f"_m{i}") for i, o in enumerate(order)])
    flipped = left.withColumn("_neg", -F.col(at))
    return asof(flipped, mirrored, keys, "_neg", [f"_m{i}" for i in range(len(order))], value, name, width, fine).drop("_neg")
