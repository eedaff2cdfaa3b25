"""Re-matching the gaps between chained matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import WIDTH, ranked, shared, with_next
from . import gaps as gp, matching, seqs


def open_gaps(blocks: DataFrame, mums: DataFrame, contigs: DataFrame, least: int, outlier_factor: float | None = 5.0) -> DataFrame:
    """gap, seq_idx, path, contig, l_start, l_end, left (global): what can be re-matched of gaps that reach ``least``."""
    g = gp.gaps(blocks, mums)
    wide = shared(g.join(gp.to_enhance(g, least).select("gap"), "gap", "left_semi"))
    usable = gp.usable(wide, gp.outliers(wide, outlier_factor), contigs)
    paths = contigs.select("seq_idx", "contig", "path")
    return usable.join(paths, ["seq_idx", "contig"]).join(wide.select("gap", "seq_idx", "left"), ["gap", "seq_idx"])


def wanted(open_: DataFrame) -> DataFrame:
    """path, contig, start, end, gap, seq_idx, left: what must be read of open gaps."""
    return open_.select("path", "contig", F.col("l_start").alias("start"), F.col("l_end").alias("end"), "gap", "seq_idx", "left")


def slices(open_: DataFrame, pieces: DataFrame) -> DataFrame:
    """gap, seq_idx, left, seq: the sequences of open gaps, from sequences in pieces (see :func:`seqs.fetch_pieces`)."""
    return of_slices(seqs.fetch_pieces(wanted(open_), pieces))


def of_slices(fetched: DataFrame) -> DataFrame:
    """gap, seq_idx, left, seq of fetched rows that hold anything."""
    return fetched.select("gap", "seq_idx", "left", F.col("slice").alias("seq")).where("seq <> ''")


def rematch(gap_slices: DataFrame, min_length: int, width: int = WIDTH) -> DataFrame:
    """gap, match, seq_idx, start, length, strand: unique matches within the gaps, over the genomes each gap has, as far as
    they are chained: two that follow each other in all these genomes."""
    found = shared(matching.multi_matches(gap_slices, "gap", min_length, both_strands=True))
    lefts = gap_slices.select("gap", "seq_idx", "left")
    found = found.join(lefts, ["gap", "seq_idx"]).select("gap", "match", "seq_idx", (F.col("left") + F.col("pos")).alias("start"), "length", "strand")
    n = with_next(found, ["gap", "seq_idx"], ["start", "match"], ["match", "strand"], width=width).where("next.strand = strand")
    a, b = F.col("match"), F.col("next.match")
    pairs = n.select("gap", F.when(F.col("strand"), a).otherwise(b).alias("l"), F.when(F.col("strand"), b).otherwise(a).alias("r"))
    present = gap_slices.groupBy("gap").agg(F.count("*").alias("genomes"))
    chained = pairs.groupBy("gap", "l", "r").agg(F.count("*").alias("m")).join(present, "gap").where("m = genomes")
    kept = chained.select("gap", F.explode(F.array("l", "r")).alias("match")).distinct()
    return found.join(kept, ["gap", "match"], "left_semi")


def enhanced_table(mums: DataFrame, found: DataFrame, genomes: int, width: int = WIDTH) -> DataFrame:
    """The match table and the new matches, in the order of the first genome (matches it lacks come first), renumbered;
    genomes without a new match get start -1."""
    every = found.select("gap", "match", "length").distinct().select("gap", "match", "length", F.explode(F.sequence(F.lit(0), F.lit(genomes - 1))).alias("seq_idx"))
    new = every.join(found.drop("length"), ["gap", "match", "seq_idx"], "left")
    new = new.select(F.col("gap").alias("a"), F.col("match").alias("b"), "seq_idx", F.coalesce("start", F.lit(-1)).cast("bigint").alias("start"), "length", F.coalesce("strand", F.lit(False)).alias("strand"))
    old = mums.select(F.col("mum_id").alias("a"), F.lit(-1).cast("bigint").alias("b"), "seq_idx", "start", "length", "strand")
    rows = old.unionByName(new)
    order = ranked(rows.where("seq_idx = 0").select("start", "a", "b"), [], ["start", "a", "b"], "mum_id", width).select("a", "b", F.col("mum_id").cast("bigint").alias("mum_id"))
    return rows.join(order, ["a", "b"]).select("mum_id", "seq_idx", "start", "length", "strand")


def enhance(mums: DataFrame, blocks: DataFrame, contigs: DataFrame, pieces: DataFrame, genomes: int, least_gap: int, min_length: int, outlier_factor: float | None = 5.0) -> DataFrame:
    """A match table with further matches in its gaps."""
    open_ = open_gaps(blocks, mums, contigs, least_gap, outlier_factor)
    return enhanced_table(mums, rematch(shared(slices(open_, pieces)), min_length), genomes)
