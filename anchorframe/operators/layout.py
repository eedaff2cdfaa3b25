"""Row order, bins and statistics that the binary index holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar
from ..functions.ordered import WIDTH, asof, asof_next, fitting, ranked, running_sum, shared, with_next


def bin_of(width: int, at: str = "start") -> Column:
    return F.floor(F.col(at) / width).cast("bigint")


def sort_by_genome(mums: DataFrame, seq_idx: int, width: int = WIDTH, absent: bool = False) -> DataFrame:
    """mum_id and new_id, its row number when sorted by one genome's start; with ``absent`` matches that the genome lacks
    (start -1) come first, otherwise they are left out."""
    own = mums.where((F.col("seq_idx") == seq_idx) & ((F.col("start") >= 0) | F.lit(absent))).select("mum_id", "start")
    return ranked(own, [], ["start", "mum_id"], "new_id", width).select("mum_id", F.col("new_id").cast("bigint").alias("new_id"))


def disorder(mums: DataFrame, width: int = WIDTH) -> DataFrame:
    """seq_idx, n_violations: adjacent rows (by mum_id) whose start decreases; 0 means sorted."""
    n = with_next(mums.select("seq_idx", "mum_id", "start"), ["seq_idx"], ["mum_id"], ["start"], width=width)
    return n.groupBy("seq_idx").agg(F.count_if(F.col("next.start") < F.col("start")).cast("bigint").alias("n_violations"))


def bin_runs(mums: DataFrame, bin_width: int, width: int = WIDTH) -> DataFrame:
    """seq_idx, bin, lo, hi: maximal runs [lo, hi) of rows (by mum_id, absent ones end a run) in one bin."""
    b = mums.select("seq_idx", "mum_id", F.when(F.col("start") >= 0, bin_of(bin_width)).otherwise(F.lit(-1)).alias("bin"))
    after = with_next(b, ["seq_idx"], ["mum_id"], ["mum_id", "bin"], width=width)
    # the row after a change starts a run; the first row of a genome does too
    starts = after.where("next.bin <> bin").select("seq_idx", F.col("next.mum_id").alias("mum_id"), F.col("next.bin").alias("bin"))
    firsts = b.groupBy("seq_idx").agg(F.min_by(F.struct("mum_id", "bin"), "mum_id").alias("f"), (F.max("mum_id") + 1).alias("n"))
    starts = starts.unionByName(firsts.select("seq_idx", "f.mum_id", "f.bin"))
    runs = with_next(starts, ["seq_idx"], ["mum_id"], ["mum_id"], width=width).join(firsts.select("seq_idx", "n"), "seq_idx")
    return runs.where("bin >= 0").select("seq_idx", "bin", F.col("mum_id").alias("lo"), F.coalesce("next.mum_id", "n").alias("hi"))


def bin_spans(mums: DataFrame, bin_width: int) -> DataFrame:
    """seq_idx, bin, span_min, span_max, n of every bin up to a genome's last; empty bins have null spans."""
    own = mums.where("start >= 0").groupBy("seq_idx", bin_of(bin_width).alias("bin")).agg(F.min("start").alias("span_min"), F.max(F.col("start") + F.col("length")).alias("span_max"), F.count("*").alias("n"))
    every = own.groupBy("seq_idx").agg(F.max("bin").alias("top")).select("seq_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("bin"))
    return every.join(own, ["seq_idx", "bin"], "left").select("seq_idx", "bin", "span_min", "span_max", F.coalesce("n", F.lit(0)).alias("n"))


def bin_offsets(mums: DataFrame, seq_idx: int, bin_width: int, width: int = WIDTH) -> DataFrame:
    """bin, first_row, n: rows before each bin when sorted by the genome's start, and rows in it."""
    b = bin_spans(mums.where(F.col("seq_idx") == seq_idx), bin_width).select("bin", "n")
    r = running_sum(b, [], ["bin"], F.col("n"), "upto", width)
    return r.select("bin", (F.col("upto") - F.col("n")).alias("first_row"), "n")


def occupied(mums: DataFrame, bin_width: int) -> DataFrame:
    """seq_idx, bin, span_min, span_max, n of every match by itself: what :func:`bin_spans` sums up, for the searches below,
    which look at few bins and need not have all of them summed up first."""
    return mums.where("start >= 0").select("seq_idx", bin_of(bin_width).alias("bin"), F.col("start").alias("span_min"), (F.col("start") + F.col("length")).alias("span_max"), F.lit(1).cast("bigint").alias("n"))


#: Bins of a block in which the nearest one is looked for first.
NEAR = 64


def nearest_bins(points: DataFrame, spans: DataFrame, at: str, width: int = WIDTH) -> DataFrame:
    """``points`` (seq_idx and a bin ``at``) with left_bin and right_bin, the nearest non-empty ones on either side.

    A bin may have several rows in ``spans`` (see :func:`occupied`).
    """
    full = spans.where("n > 0").select("seq_idx", "bin")
    p = asof(points, full, ["seq_idx"], at, ["bin"], ["bin"], "_l", width, NEAR)
    p = asof_next(p, full, ["seq_idx"], at, ["bin"], ["bin"], "_r", width, NEAR)
    return p.withColumns({"left_bin": F.col("_l.bin"), "right_bin": F.col("_r.bin")}).drop("_l", "_r")


def flank_bins(regions: DataFrame, spans: DataFrame, bin_width: int, width: int = WIDTH) -> DataFrame:
    """region_id, left_bin, right_bin: bins that hold a region's bounding matches.

    From the region's first bin to the nearest non-empty one on the left; if that starts after the region, once more to
    the next on the left; likewise on the right with the last base and the bins' ends. Null where neither bounds. A bin
    may have several rows in ``spans`` (see :func:`occupied`); only bins that were found are summed up.
    """
    full = spans.where("n > 0").select("seq_idx", "bin", "span_min", "span_max")

    def with_span(p: DataFrame, name: str) -> DataFrame:
        wanted = shared(p.select("seq_idx", F.col(f"{name}.bin").alias("bin")).where("bin is not null").distinct())
        own = full.join(fitting(wanted), ["seq_idx", "bin"]).groupBy("seq_idx", "bin").agg(F.min("span_min").alias("span_min"), F.max("span_max").alias("span_max"))
        own = shared(own.select(F.col("seq_idx").alias("_s"), F.struct("bin", "span_min", "span_max").alias(f"_{name}")))
        same = (F.col("seq_idx") == F.col("_s")) & (F.col(f"{name}.bin") == F.col(f"_{name}.bin"))
        return p.join(fitting(own), same, "left").drop("_s", name).withColumnRenamed(f"_{name}", name)

    p = regions.select("region_id", "seq_idx", F.col("start").alias("s"), (F.col("end") - 1).alias("e"))
    p = p.withColumns({"b0": F.floor(F.col("s") / bin_width).cast("bigint"), "b1": F.floor(F.col("e") / bin_width).cast("bigint")})
    for side, find, step, good in (("l", asof, -1, lambda x: F.col(f"{x}.span_min") <= F.col("s")), ("r", asof_next, 1, lambda x: F.col(f"{x}.span_max") > F.col("e"))):
        at = "b0" if side == "l" else "b1"
        p = with_span(find(p, full, ["seq_idx"], at, ["bin"], ["bin"], f"{side}1", width, NEAR), f"{side}1")
        p = p.withColumn("_at", F.coalesce(F.col(f"{side}1.bin") + step, F.lit(step * (1 << 60))))
        p = with_span(find(p, full, ["seq_idx"], "_at", ["bin"], ["bin"], f"{side}2", width, NEAR).drop("_at"), f"{side}2")
        p = p.withColumn(f"{side}_bin", F.when(good(f"{side}1"), F.col(f"{side}1.bin")).when(F.col(f"{side}1").isNotNull() & good(f"{side}2"), F.col(f"{side}2.bin")))
    return p.select("region_id", F.col("l_bin").alias("left_bin"), F.col("r_bin").alias("right_bin"))


def lengths_checksum(mums: DataFrame, sample: int = 1000) -> DataFrame:
    """n_sampled, checksum: SHA-256 over the first lengths (64-bit, little-endian), its first 8 bytes as a number."""
    own = mums.where(F.col("seq_idx") == 0).select("mum_id", "length").orderBy("mum_id").limit(sample)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mum_id", "length"))), lambda x: scalar.little_endian(x["length"])), "")
    digest = own.agg(F.count("*").alias("n_sampled"), F.sha2(F.unhex(text), 256).alias("d"))
    return digest.select("n_sampled", F.conv(F.substring("d", 1, 16), 16, 10).alias("checksum"))


def wide(mums: DataFrame) -> DataFrame:
    """mum_id, length, starts, strands (arrays by seq_idx)."""
    cells = F.array_sort(F.collect_list(F.struct("seq_idx", "start", "strand")))
    w = mums.groupBy("mum_id").agg(F.first("length").alias("length"), cells.alias("x"))
    return w.select("mum_id", "length", F.transform("x", lambda c: c["start"]).alias("starts"), F.transform("x", lambda c: c["strand"]).alias("strands"))


def long(table: DataFrame) -> DataFrame:
    """The long form of :func:`wide`."""
    x = table.select("mum_id", "length", F.posexplode(F.arrays_zip("starts", "strands")).alias("seq_idx", "c"))
    return x.select("mum_id", "seq_idx", F.col("c.starts").alias("start"), "length", F.col("c.strands").alias("strand"))


def table_stats(mums: DataFrame) -> DataFrame:
    return mums.agg(F.countDistinct("mum_id").alias("n_mums"), F.countDistinct("seq_idx").alias("n_seqs"), F.count_if(F.col("start") >= 0).alias("n_present"), F.count_if(~F.col("strand")).alias("n_reverse"), F.max("length").alias("max_length"))
