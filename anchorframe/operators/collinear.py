"""Collinear structure: neighbours, adjacencies that all genomes share, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import WIDTH, ranked, running_sum, shared, with_next


def neighbour_pairs(mums: DataFrame, width: int = WIDTH) -> DataFrame:
    """seq_idx, l, r: neighbours of equal strand in each genome, in reading direction (swapped on the reverse strand)."""
    m = mums.where("start >= 0").select("seq_idx", "mum_id", "start", "strand")
    n = with_next(m, ["seq_idx"], ["start", "mum_id"], ["mum_id", "strand"], width=width).where("next.strand = strand")
    l, r = F.col("mum_id"), F.col("next.mum_id")
    return n.select("seq_idx", F.when(F.col("strand"), l).otherwise(r).alias("l"), F.when(F.col("strand"), r).otherwise(l).alias("r"))


def facing_forward(mums: DataFrame) -> DataFrame:
    """The same matches, each read so that the first genome has it forward: those it has reversed are turned over in all
    genomes. A table that needs none of this is given back as it is."""
    turned = mums.where("seq_idx = 0 and start >= 0 and not strand").select("mum_id")
    if turned.isEmpty():
        return mums
    own = mums.join(turned.withColumn("turn", F.lit(True)), "mum_id", "left")
    return own.select("mum_id", "seq_idx", "start", "length", (F.col("strand") != F.coalesce("turn", F.lit(False))).alias("strand"))


def common_adjacency(mums: DataFrame, genomes: int, width: int = WIDTH) -> DataFrame:
    """l, r: pairs that follow each other in every genome."""
    return neighbour_pairs(mums, width).groupBy("l", "r").agg(F.count("*").alias("m")).where(F.col("m") == genomes).select("l", "r")


def islands(numbers: DataFrame, col: str, width: int = WIDTH) -> DataFrame:
    """s, e: maximal runs of consecutive distinct numbers, inclusive."""
    x = shared(numbers.select(F.col(col).alias("x")))
    n = with_next(x, [], ["x"], ["x"], width=width)
    # where a run ends the next one starts, if there is one
    ends = shared(n.where("next is null or next.x <> x + 1").select(F.col("x").alias("e"), F.col("next.x").alias("s")))
    later = with_next(ends, [], ["e"], ["e"], width=width).where("next is not null").select("s", F.col("next.e").alias("e"))
    none = F.lit(None).cast("bigint")
    first = x.agg(F.min("x").alias("s")).select("s", none.alias("e")).unionByName(ends.agg(F.min("e").alias("e")).select(none.alias("s"), "e"))
    return later.unionByName(first.agg(F.max("s").alias("s"), F.max("e").alias("e")).where("s is not null"))


def collinear_blocks(mums: DataFrame, genomes: int, width: int = WIDTH) -> DataFrame:
    """s, e: inclusive ranges of rows that are chained in every genome.

    Rows are taken in the order of the first genome, where chained rows follow each other (see layout.sort_by_genome);
    matches that it has reversed are turned over first.
    """
    pairs = common_adjacency(facing_forward(mums), genomes, width).where("r = l + 1")
    return islands(pairs, "l", width).select("s", (F.col("e") + 1).alias("e"))


def block_rows(blocks: DataFrame) -> DataFrame:
    """s, mum_id of every row of the blocks."""
    return blocks.select("s", F.explode(F.sequence("s", "e")).alias("mum_id"))


def renumbered(blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """s, e, new_s, new_e: inclusive block ranges after all other rows are dropped."""
    r = running_sum(blocks, [], ["s"], F.col("e") - F.col("s") + 1, "upto", width)
    return r.select("s", "e", (F.col("upto") - (F.col("e") - F.col("s") + 1)).alias("new_s"), (F.col("upto") - 1).alias("new_e"))


def filter_collinear(blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """mum_id, new_id, block: rows that stay, their new numbers, and the first (new) row of their block."""
    r = renumbered(blocks, width)
    return r.select(F.explode(F.sequence("s", "e")).alias("mum_id"), "s", "new_s").select("mum_id", (F.col("new_s") + F.col("mum_id") - F.col("s")).alias("new_id"), F.col("new_s").alias("block"))


def collinear_share(blocks: DataFrame, mums: DataFrame) -> DataFrame:
    """n_blocks, n_collinear, n_mums, percent (3 decimals)."""
    n = mums.where("seq_idx = 0").agg(F.count("*").alias("n_mums"))
    b = blocks.agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum(F.col("e") - F.col("s") + 1), F.lit(0)).alias("n_collinear"))
    return b.join(n).select("n_blocks", "n_collinear", "n_mums", F.round(F.col("n_collinear") * 100.0 / F.col("n_mums").cast("double"), 3).alias("percent"))


def oriented_blocks(mums: DataFrame, genomes: int, width: int = WIDTH) -> DataFrame:
    """block, s, e, n: chains of shared adjacencies whose rows have the same strands in every genome.

    Neighbours of one strand in each of all genomes agree in the strands of all, so nothing about strands need be
    compared again, for any number of genomes.
    """
    b = islands(common_adjacency(mums, genomes, width).where("r = l + 1"), "l", width).select("s", (F.col("e") + 1).alias("e"))
    return ranked(b, [], ["s"], "block", width).select(F.col("block").cast("bigint").alias("block"), "s", "e", (F.col("e") - F.col("s") + 1).alias("n"))


def rearranged(blocks: DataFrame, mums: DataFrame, width: int = WIDTH) -> DataFrame:
    """block, seq_idx: blocks whose head comes before the preceding block's head in a genome, and those before them."""
    heads = blocks.select("block", F.col("s").alias("mum_id")).join(mums.where("start >= 0").select("mum_id", "seq_idx", "start"), "mum_id")
    return out_of_order(shared(heads.select("seq_idx", "block", "start")), width)


def out_of_order(heads: DataFrame, width: int = WIDTH) -> DataFrame:
    """block, seq_idx of ``heads`` (seq_idx, block, start) that start before the block before them, and those before them."""
    n = with_next(heads, ["seq_idx"], ["block"], ["block", "start"], width=width).where("next.start < start")
    return n.select(F.explode(F.array("block", "next.block")).alias("block"), "seq_idx").distinct()


def walk_steps(blocks: DataFrame, mums: DataFrame, width: int = WIDTH) -> DataFrame:
    """seq_idx, place, block, direction: blocks in the order in which each genome passes them."""
    h = blocks.select("block", F.col("s").alias("mum_id")).join(mums.where("start >= 0").select("mum_id", "seq_idx", "start", "strand"), "mum_id")
    r = ranked(h, ["seq_idx"], ["start", "mum_id"], "place", width)
    return r.select("seq_idx", F.col("place").cast("bigint").alias("place"), "block", F.when(F.col("strand"), F.lit("+")).otherwise(F.lit("-")).alias("direction"))


def links(blocks: DataFrame, mums: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, a_dir, b, b_dir: distinct steps between blocks over all genomes."""
    w = with_next(walk_steps(blocks, mums, width), ["seq_idx"], ["place"], ["block", "direction"], width=width).where("next is not null")
    return w.select(F.col("block").alias("a"), F.col("direction").alias("a_dir"), F.col("next.block").alias("b"), F.col("next.direction").alias("b_dir")).distinct()


def polygons(blocks: DataFrame, mums: DataFrame) -> DataFrame:
    """block, seq_idx, x0, x1, y0, y1: corners of each block between neighbouring genomes, as a drawing of synteny has them."""
    m = mums.select("mum_id", "seq_idx", "start", (F.col("start") + F.col("length")).alias("end"))
    head = blocks.select("block", F.col("s").alias("mum_id")).join(m, "mum_id").select("block", "seq_idx", F.col("start").alias("hs"), F.col("end").alias("he"))
    tail = blocks.select("block", F.col("e").alias("mum_id")).join(m, "mum_id").select("block", "seq_idx", F.col("start").alias("ts"), F.col("end").alias("te"))
    x = head.join(tail, ["block", "seq_idx"]).select("block", "seq_idx", F.least("hs", "ts").alias("x0"), F.greatest("he", "te").alias("x1"))
    n = with_next(x, ["block"], ["seq_idx"], ["x0", "x1"]).where("next is not null")
    return n.select("block", "seq_idx", "x0", "x1", F.col("next.x0").alias("y0"), F.col("next.x1").alias("y1"))
