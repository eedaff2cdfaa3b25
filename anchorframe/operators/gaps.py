"""Gaps between chained matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import shared
from . import coords


def gaps(blocks: DataFrame, mums: DataFrame) -> DataFrame:
    """gap (its left row), seq_idx, left, right, gap_len of all neighbours in a block; lengths may be negative."""
    pairs = blocks.where("e > s").select(F.explode(F.sequence("s", F.col("e") - 1)).alias("gap"))
    side = lambda k, shift: mums.select((F.col("mum_id") - shift).alias("gap"), "seq_idx", F.col("start").alias(f"{k}s"), F.col("length").alias(f"{k}n"))
    j = pairs.join(side("l", 0), "gap").join(side("r", 1), ["gap", "seq_idx"])
    flip = F.col("rs") < F.col("ls")
    return j.select(
        "gap",
        "seq_idx",
        F.when(flip, F.col("rs") + F.col("rn")).otherwise(F.col("ls") + F.col("ln")).alias("left"),
        F.when(flip, F.col("ls")).otherwise(F.col("rs")).alias("right"),
        (F.abs(F.col("ls") - F.col("rs")) - F.when(flip, F.col("rn")).otherwise(F.col("ln"))).alias("gap_len"),
    )


def to_enhance(gap_rows: DataFrame, least: int) -> DataFrame:
    """gap, max_len of gaps that reach ``least`` in any genome."""
    return gap_rows.groupBy("gap").agg(F.max("gap_len").alias("max_len")).where(F.col("max_len") >= least)


def outliers(gap_rows: DataFrame, factor: float | None = 5.0) -> DataFrame:
    """gap, seq_idx, gap_len, med, mad, masked: lengths far below a gap's median (by median absolute deviations)."""
    med = gap_rows.groupBy("gap").agg(F.median("gap_len").alias("med"))
    j = shared(gap_rows.select("gap", "seq_idx", "gap_len").join(med, "gap"))
    mad = j.groupBy("gap").agg(F.median(F.abs(F.col("gap_len") - F.col("med"))).alias("mad"))
    mad = mad.withColumn("mad", F.when(F.col("mad") == 0, F.lit(1.0)).otherwise(F.col("mad")))
    masked = F.lit(False) if factor is None else F.col("gap_len") < F.col("med") - F.lit(float(factor)) * F.col("mad")
    return j.join(mad, "gap").withColumn("masked", masked)


def usable(gap_rows: DataFrame, masked: DataFrame, contigs: DataFrame) -> DataFrame:
    """gap, seq_idx, contig, l_start, l_end of gaps that can be re-matched: not masked, not empty, in one contig."""
    open_ = gap_rows.where("left >= 0 and right > left").join(masked.where("masked").select("gap", "seq_idx"), ["gap", "seq_idx"], "left_anti")
    local = coords.to_local(open_.withColumn("last", F.col("right") - 1), contigs, "left", "last").where("reason is null")
    return local.select("gap", "seq_idx", "contig", "l_start", "l_end")


def enhanced(mums: DataFrame, found: DataFrame, first: int, genomes: int) -> DataFrame:
    """Union of a match table and further matches (cut, seq_idx, start, length, strand), renumbered after ``first``;
    genomes that lack a further match get start -1."""
    every = found.select("cut").distinct().select("cut", F.explode(F.sequence(F.lit(0), F.lit(genomes - 1))).alias("seq_idx"))
    full = every.join(found, ["cut", "seq_idx"], "left")
    length = found.groupBy("cut").agg(F.max("length").alias("n"))
    full = full.drop("length").join(length, "cut")
    new = full.select((F.lit(first) + F.col("cut")).alias("mum_id"), "seq_idx", F.coalesce("start", F.lit(-1)).cast("bigint").alias("start"), F.col("n").alias("length"), F.coalesce("strand", F.lit(True)).alias("strand"))
    return mums.select("mum_id", "seq_idx", "start", "length", "strand").unionByName(new)


def overlaps(pairs: DataFrame, mums: DataFrame) -> DataFrame:
    """l, r, loser, cut: the deepest overlap of each overlapping pair, and the match that loses it: the longer one, the
    right one on ties. Pairs are judged on the matches as given."""
    side = lambda k: mums.select(F.col("mum_id").alias(k), "seq_idx", F.col("start").alias(f"{k}s"), F.col("length").alias(f"{k}n"))
    j = pairs.join(side("l"), "l").join(side("r"), ["r", "seq_idx"])
    gap = F.abs(F.col("ls") - F.col("rs")) - F.when(F.col("rs") < F.col("ls"), F.col("rn")).otherwise(F.col("ln"))
    d = j.groupBy("l", "r").agg(F.min(gap).alias("g"), F.first("ln").alias("ln"), F.first("rn").alias("rn")).where("g < 0")
    return d.select("l", "r", F.when(F.col("ln") > F.col("rn"), F.col("l")).otherwise(F.col("r")).alias("loser"), (-F.col("g")).alias("cut"))


def trimmed(pairs: DataFrame, mums: DataFrame) -> DataFrame:
    """mum_id, cut: how much each match of an overlapping pair must lose so that no genome's gap is negative; a match in
    several pairs loses the largest of its cuts."""
    return overlaps(pairs, mums).groupBy(F.col("loser").alias("mum_id")).agg(F.max("cut").alias("cut"))


def without_overlaps(pairs: DataFrame, mums: DataFrame) -> DataFrame:
    """The match table after trimming. A left match loses its end and a right one its beginning, as the first genome reads
    them, so starts move in the genomes that read that side first; what would be cut to nothing is left out."""
    cuts = overlaps(pairs, mums).groupBy(F.col("loser").alias("mum_id")).agg(
        F.max(F.when(F.col("loser") == F.col("l"), F.col("cut")).otherwise(0)).alias("tail"), F.max(F.when(F.col("loser") == F.col("r"), F.col("cut")).otherwise(0)).alias("head")
    )
    m = mums.join(cuts, "mum_id", "left").fillna(0, ["head", "tail"])
    start = F.when(F.col("start") < 0, F.col("start")).otherwise(F.col("start") + F.when(F.col("strand"), F.col("head")).otherwise(F.col("tail")))
    out = m.select("mum_id", "seq_idx", start.cast("bigint").alias("start"), (F.col("length") - F.col("head") - F.col("tail")).cast("bigint").alias("length"), "strand")
    return out.where("length > 0")
