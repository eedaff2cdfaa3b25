"""Sequence graphs over oriented blocks: alleles between anchors, stretches between blocks, walks and their breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import WIDTH, running_sum, shared, with_next
from . import collinear


def inner_intervals(blocks: DataFrame, mums: DataFrame) -> DataFrame:
    """block, gap (place of its left row in the block), seq_idx, start, end, forward, l (the left row): what lies between
    neighbouring rows of a block in each genome, read in the genome's own direction of the block."""
    pairs = blocks.where("e > s").select("block", "s", F.explode(F.sequence("s", F.col("e") - 1)).alias("l"))
    side = lambda k, shift: mums.select((F.col("mum_id") - shift).alias("l"), "seq_idx", F.col("start").alias(f"{k}s"), (F.col("start") + F.col("length")).alias(f"{k}e"), F.col("strand").alias(f"{k}f"))
    j = pairs.hint("merge").join(side("a", 0), "l").hint("merge").join(side("b", 1).drop("bf"), ["l", "seq_idx"])
    return j.select("block", (F.col("l") - F.col("s")).alias("gap"), "seq_idx", F.when(F.col("af"), F.col("ae")).otherwise(F.col("be")).alias("start"), F.when(F.col("af"), F.col("bs")).otherwise(F.col("as")).alias("end"), F.col("af").alias("forward"), "l")


def _numbered(between: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of :func:`alleles` and those without a sequence, whose ``allele`` is null."""
    more = [c for c in between.columns if c not in (*keys, "seq", "seq_idx")]
    rows = between.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq_idx", "seq", *more))).alias("_rows"))  # genomes at most
    seqs = F.array_compact(F.array_distinct(F.transform("_rows", lambda x: x["seq"])))
    one = rows.withColumn("_seqs", seqs).select(*keys, "_seqs", F.explode("_rows").alias("_x"))
    return one.select(*keys, "_x.seq", "_x.seq_idx", *[f"_x.{c}" for c in more], (F.array_position("_seqs", F.col("_x.seq")) - 1).cast("int").alias("allele"))


def alleles(between: DataFrame, keys: list[str]) -> DataFrame:
    """``between`` (keys, seq_idx, seq) with ``allele``: the number of its sequence among those of its keys, in the order of
    the first genome that has it. Equal sequences are one allele; an empty one has a number, too."""
    return _numbered(between.where("seq is not null"), keys)


# How nodes within blocks and anchors are named.
NODE, ANCHOR = "oblock%d_g%d_a%d", "oblock%d_m%d"


def bubble_nodes(between: DataFrame) -> DataFrame:
    """block, gap, seq_idx, name: the node each genome passes between two rows of a block; null where nothing lies between."""
    return alleles(between, ["block", "gap"]).select("block", "gap", "seq_idx", _node().alias("name"))


def _node() -> Column:
    name = F.format_string(NODE, F.col("block").cast("bigint"), F.col("gap").cast("bigint"), F.col("allele").cast("bigint"))
    return F.when(F.col("seq") != "", name)


def inner_links(between: DataFrame) -> DataFrame:
    """a, a_dir, b, b_dir: the distinct steps between nodes within blocks, of ``between`` (block, gap, l, seq_idx, forward, seq).

    The rows of :func:`node_links` over :func:`block_walk`. A walk through a block passes the two rows beside a gap and what
    lies between one after another, in all genomes, so each gap has its own steps and the walks need not be put in order.
    """
    row = lambda k: F.format_string(ANCHOR, F.col("block").cast("bigint"), F.col("l") + k)
    n = _numbered(between, ["block", "gap"]).select("block", "gap", "forward", F.array_compact(F.array(row(0), _node(), row(1))).alias("way"))
    n = n.select("block", "gap", "forward", F.when(F.col("forward"), F.col("way")).otherwise(F.reverse("way")).alias("way")).distinct()
    step = n.select("block", "gap", F.when(F.col("forward"), F.lit("+")).otherwise(F.lit("-")).alias("dir"), F.explode(F.arrays_zip(F.slice("way", F.lit(1), F.size("way") - 1).alias("a"), F.slice("way", F.lit(2), F.size("way") - 1).alias("b"))).alias("x"))
    return step.select("block", "gap", F.col("x.a").alias("a"), F.col("dir").alias("a_dir"), F.col("x.b").alias("b"), F.col("dir").alias("b_dir")).distinct().drop("block", "gap")


def block_walk(blocks: DataFrame, mums: DataFrame, nodes: DataFrame) -> DataFrame:
    """block, seq_idx, place, name, direction: the anchors and alleles each genome passes within a block, in its own order; a
    genome that reads the block backwards passes them from the last to the first."""
    rows = collinear.block_rows(blocks.select("s", "e")).join(blocks.select("s", "block"), "s")
    forward = mums.where("start >= 0").select("mum_id", "seq_idx", "strand")
    anchor = rows.join(forward, "mum_id").select("block", "seq_idx", "strand", (2 * (F.col("mum_id") - F.col("s"))).alias("k"), F.format_string(ANCHOR, F.col("block").cast("bigint"), F.col("mum_id")).alias("name"))
    facing = anchor.where("k = 0").select("block", "seq_idx", "strand")
    inner = nodes.where("name is not null").join(facing, ["block", "seq_idx"]).select("block", "seq_idx", "strand", (2 * F.col("gap") + 1).alias("k"), "name")
    place = F.when(F.col("strand"), F.col("k")).otherwise(-F.col("k"))
    return anchor.unionByName(inner).select("block", "seq_idx", place.alias("place"), "name", F.when(F.col("strand"), F.lit("+")).otherwise(F.lit("-")).alias("direction"))


def node_links(walk: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, a_dir, b, b_dir: the distinct steps between nodes that any genome's walk through a block takes."""
    n = with_next(walk, ["block", "seq_idx"], ["place"], ["name", "direction"], width=width).where("next is not null")
    return n.select(F.col("name").alias("a"), F.col("direction").alias("a_dir"), F.col("next.name").alias("b"), F.col("next.direction").alias("b_dir")).distinct()


def block_spans(blocks: DataFrame, mums: DataFrame) -> DataFrame:
    """block, seq_idx, start, end of each block in each genome, and head, where its first row starts."""
    ends = blocks.select("block", F.explode(F.array_distinct(F.array(F.struct(F.col("s").alias("mum_id"), F.lit(True).alias("first")), F.struct(F.col("e").alias("mum_id"), (F.col("s") == F.col("e")).alias("first"))))).alias("x")).select("block", "x.mum_id", "x.first")
    m = mums.where("start >= 0").select("mum_id", "seq_idx", "start", (F.col("start") + F.col("length")).alias("end"))
    return ends.hint("merge").join(m, "mum_id").groupBy("block", "seq_idx").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("first"), F.col("start"))).alias("head"))


def interblock(blocks: DataFrame, mums: DataFrame, max_gap: int = 100_000, width: int = WIDTH) -> DataFrame:
    """seq_idx, block, lo, hi, walk, joined: the stretch before each block, whether it joins the block to the one before, and
    the number of the genome's walk that the block is in.

    A genome's walk breaks where the block or the one before is rearranged in it, where nothing lies between, and, but for
    the first genome, where more than ``max_gap`` bases do.
    """
    spans = shared(block_spans(blocks, mums))
    ends = spans.select("seq_idx", "block", "start", "end")
    origin = spans.select("seq_idx").distinct().select("seq_idx", F.lit(-1).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"))
    n = with_next(ends.unionByName(origin), ["seq_idx"], ["block"], ["block", "start"], width=width).where("next is not null")
    gap = n.select("seq_idx", F.col("next.block").alias("block"), F.col("end").alias("lo"), F.col("next.start").alias("hi"))
    moved = collinear.out_of_order(spans.where("head is not null").select("seq_idx", "block", F.col("head").alias("start")), width)
    moved = moved.select("seq_idx", F.explode(F.array("block", F.col("block") + 1)).alias("block")).distinct().withColumn("moved", F.lit(True))
    size = F.col("hi") - F.col("lo")
    joined = F.col("moved").isNull() & (size > 0) & ((F.col("seq_idx") == 0) | (size <= max_gap))
    out = shared(gap.join(moved, ["seq_idx", "block"], "left").withColumn("joined", joined))
    out = running_sum(out, ["seq_idx"], ["block"], (~F.col("joined")).cast("int"), "walk", width)
    return out.select("seq_idx", "block", "lo", "hi", "joined", "walk")
