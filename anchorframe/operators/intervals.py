"""Interval overlap: a region against matches, and many regions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BIN = 1 << 16


def overlapping(mums: DataFrame, seq_idx: int, start: int, end: int) -> DataFrame:
    """Present matches of one genome that overlap [start, end)."""
    return mums.where((F.col("seq_idx") == seq_idx) & (F.col("start") >= 0) & (F.col("start") < end) & (F.col("start") + F.col("length") > start))


def overlap_join(regions: DataFrame, mums: DataFrame, width: int = BIN) -> DataFrame:
    """region_id and the match's columns for every overlapping pair (present matches, half-open).

    Both sides are dealt to all bins they touch and joined by (seq_idx, bin); a pair counts in the first bin that both
    touch, so it appears once without a distinct.
    """
    to_bin = lambda c: F.floor(c / width).cast("bigint")
    r = regions.where("end > start").select("region_id", "seq_idx", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    r = r.withColumn("bin", F.explode(F.sequence(to_bin(F.col("r_start")), to_bin(F.col("r_end") - 1))))
    m = mums.where("start >= 0").withColumn("bin", F.explode(F.sequence(to_bin(F.col("start")), to_bin(F.col("start") + F.col("length") - 1))))
    both = r.join(m, ["seq_idx", "bin"]).where((F.col("start") < F.col("r_end")) & (F.col("start") + F.col("length") > F.col("r_start")))
    both = both.where(F.col("bin") == F.greatest(to_bin(F.col("r_start")), to_bin(F.col("start"))))
    return both.drop("bin", "r_start", "r_end")


def start_binned_candidates(regions: DataFrame, mums: DataFrame, width: int) -> DataFrame:
    """region_id, n_candidates, n_kept, n_exact: how an index on start bins compares with exact overlap.

    Candidates are matches whose start lies in one of the region's bins; those kept overlap it. Matches that start in
    an earlier bin are missed, so n_kept can be below n_exact.
    """
    to_bin = lambda c: F.floor(c / width).cast("bigint")
    r = regions.select("region_id", "seq_idx", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    r = r.withColumn("bin", F.explode(F.sequence(to_bin(F.col("r_start")), to_bin(F.col("r_end") - 1))))
    m = mums.where("start >= 0").withColumn("bin", to_bin(F.col("start")))
    kept = (F.col("start") < F.col("r_end")) & (F.col("start") + F.col("length") > F.col("r_start"))
    found = r.join(m, ["seq_idx", "bin"]).groupBy("region_id").agg(F.count("*").alias("n_candidates"), F.count_if(kept).alias("n_kept"))
    exact = overlap_join(regions, mums, width).groupBy("region_id").agg(F.count("*").alias("n_exact"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return regions.select("region_id").join(found, "region_id", "left").join(exact, "region_id", "left").select("region_id", zero("n_candidates"), zero("n_kept"), zero("n_exact"))
