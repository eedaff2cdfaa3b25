"""Coordinates: contigs and genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar
from ..functions.ordered import asof, small

#: A genome with more contigs than this is looked up by position blocks; with fewer, each row is tested against all.
MOST_TESTED = 256


def locate(points: DataFrame, contigs: DataFrame, at: str, prefix: str) -> DataFrame:
    """``points`` with {prefix}contig, {prefix}contig_idx and {prefix}rel of the position ``at``; null outside."""
    c = contigs.select(F.col("seq_idx").alias("_s"), F.col("contig").alias(f"{prefix}contig"), F.col("contig_idx").alias(f"{prefix}contig_idx"), F.col("offset").alias("_o"), F.col("length").alias("_l"))
    if small(contigs, MOST_TESTED):
        hit = (F.col("_s") == F.col("seq_idx")) & (F.col("_o") <= F.col(at)) & (F.col(at) < F.col("_o") + F.col("_l"))
        out = points.join(F.broadcast(c), hit, "left")
    else:
        c = c.withColumnRenamed("_s", "seq_idx").where("_l > 0")
        out = asof(points, c, ["seq_idx"], at, ["_o"], [f"{prefix}contig", f"{prefix}contig_idx", "_o", "_l"], "_c")
        inside = F.col(at) < F.col("_c._o") + F.col("_c._l")
        return out.select("*", *[F.when(inside, F.col(f"_c.{x}")).alias(x) for x in (f"{prefix}contig", f"{prefix}contig_idx")], F.when(inside, F.col(at) - F.col("_c._o")).alias(f"{prefix}rel")).drop("_c")
    return out.withColumn(f"{prefix}rel", F.col(at) - F.col("_o")).drop("_s", "_o", "_l")


def to_global(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """region_id, seq_idx, g_start, g_end_incl, g_end, reason of region texts (``region``); reason is null if valid."""
    r = regions.select(
        "region_id", "seq_idx", scalar.region_contig(F.col("region")).alias("contig"), scalar.region_start(F.col("region")).alias("s"), scalar.region_end(F.col("region")).alias("e")
    )
    c = contigs.select("seq_idx", "contig", "length", "offset")
    j = r.join(F.broadcast(c) if small(contigs) else c, ["seq_idx", "contig"], "left")
    reason = F.when(F.col("length").isNull(), F.lit("unknown contig")).when(~((F.col("s") >= 0) & (F.col("s") < F.col("e")) & (F.col("e") <= F.col("length"))), F.lit("out of range"))
    ok = lambda x: F.when(F.col("reason").isNull(), x)
    j = j.withColumn("reason", reason)
    return j.select("region_id", "seq_idx", ok(F.col("offset") + F.col("s")).alias("g_start"), ok(F.col("offset") + F.col("e") - 1).alias("g_end_incl"), ok(F.col("offset") + F.col("e")).alias("g_end"), "reason")


def to_local(intervals: DataFrame, contigs: DataFrame, start: str = "start", end_incl: str = "end_incl") -> DataFrame:
    """``intervals`` with contig, l_start, l_end_incl, l_end and reason (null if both ends lie in one contig)."""
    j = locate(locate(intervals, contigs, start, "a_"), contigs, end_incl, "b_")
    reason = F.when(F.col("a_contig_idx").isNull() | F.col("b_contig_idx").isNull(), F.lit("out of range")).when(F.col("a_contig_idx") != F.col("b_contig_idx"), F.lit("cross contig"))
    j = j.withColumn("reason", reason)
    ok = lambda x: F.when(F.col("reason").isNull(), x)
    j = j.withColumns({"contig": ok(F.col("a_contig")), "l_start": ok(F.col("a_rel")), "l_end_incl": ok(F.col("b_rel")), "l_end": ok(F.col("b_rel") + 1)})
    return j.drop("a_contig", "a_contig_idx", "a_rel", "b_contig", "b_contig_idx", "b_rel")
