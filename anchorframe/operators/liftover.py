"""Bounding matches of regions and their lift-over to the other genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import WIDTH, asof, asof_next, fitting, shared


def bounds(regions: DataFrame, mums: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per region: the last match that starts at or before it, and the first that ends after its last base.

    region_id, seq_idx, s, e_incl, left_id, left_start, left_end, right_id, right_start, right_end; both bounds exist.
    """
    m = mums.where("start >= 0").select("seq_idx", "mum_id", "start", (F.col("start") + F.col("length")).alias("end"))
    q = regions.select("region_id", "seq_idx", F.col("start").alias("s"), (F.col("end") - 1).alias("e_incl"), F.col("end").alias("after"))
    q = asof(q, m, ["seq_idx"], "s", ["start", "mum_id"], ["mum_id", "start", "end"], "l", width)
    q = asof_next(q, m, ["seq_idx"], "after", ["end", "mum_id"], ["mum_id", "start", "end"], "r", width)
    out = q.where("l is not null and r is not null")
    return out.select("region_id", "seq_idx", "s", "e_incl", *[F.col(f"{a}.{x}").alias(f"{n}_{y}") for a, n in (("l", "left"), ("r", "right")) for x, y in (("mum_id", "id"), ("start", "start"), ("end", "end"))])


def offsets(bounded: DataFrame) -> DataFrame:
    """With left_off, right_off (into the bounding matches) and the margins (distance from them, 0 if inside)."""
    in_left, in_right = F.col("s") < F.col("left_end"), F.col("e_incl") >= F.col("right_start")
    zero = F.lit(0).cast("bigint")
    return bounded.withColumns(
        {
            "left_off": F.when(in_left, F.col("s") - F.col("left_start")).otherwise(zero),
            "right_off": F.when(in_right, F.col("e_incl") - F.col("right_start")).otherwise(zero),
            "left_margin": F.when(in_left, zero).otherwise(F.col("s") - (F.col("left_end") - 1)),
            "right_margin": F.when(in_right, zero).otherwise(F.col("right_start") - F.col("e_incl")),
        }
    )


def liftover(regions: DataFrame, mums: DataFrame, width: int = WIDTH, strand_aware: bool = False) -> DataFrame:
    """region_id, seq_idx, start, end_incl, end, orientation: each region's interval in every genome.

    By default offsets are added whatever the strand, so an interval in an inverted stretch may have start > end; with
    ``strand_aware`` offsets are mirrored within reverse matches and the interval is put in order.
    """
    b = shared(offsets(bounds(regions, mums, width)).select("region_id", "left_id", "right_id", "left_off", "right_off"))
    ids = fitting(b.select(F.explode(F.array("left_id", "right_id")).alias("mum_id")).distinct())
    m = mums.where("start >= 0").join(ids, "mum_id", "left_semi")  # only the bounding matches go on
    side = lambda k: m.select(F.col("mum_id").alias(f"{k}_id"), "seq_idx", F.col("start").alias(f"{k}_s"), F.col("length").alias(f"{k}_n"), F.col("strand").alias(f"{k}_strand"))
    j = b.join(side("left"), "left_id").join(side("right"), ["right_id", "seq_idx"])
    at = lambda k: F.col(f"{k}_s") + F.col(f"{k}_off")
    if strand_aware:
        at = lambda k: F.when(F.col(f"{k}_strand"), F.col(f"{k}_s") + F.col(f"{k}_off")).otherwise(F.col(f"{k}_s") + F.col(f"{k}_n") - 1 - F.col(f"{k}_off"))
    lo, hi = at("left"), at("right")
    orientation = F.when(lo > hi, F.lit("-")).otherwise(F.lit("+"))
    if strand_aware:
        lo, hi = F.least(lo, hi), F.greatest(lo, hi)
    return j.select("region_id", "seq_idx", lo.alias("start"), hi.alias("end_incl"), (hi + 1).alias("end"), orientation.alias("orientation"))


def pick_sequences(df: DataFrame, chosen: list[int]) -> DataFrame:
    """Rows of the chosen genomes, with ``position``, their place in the list."""
    if len(set(chosen)) != len(chosen) or any(s < 0 for s in chosen):
        raise ValueError("genome indices must be distinct and not negative")
    place = F.create_map(*[F.lit(x) for i, s in enumerate(chosen) for x in (s, i)])
    return df.where(F.col("seq_idx").isin(chosen)).withColumn("position", place[F.col("seq_idx")])
