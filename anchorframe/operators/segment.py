"""Greedy segmentation of genomes into syntenic strips."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import WIDTH, running_sum, shared, with_next
from .coords import locate


def contig_breaks(rows: DataFrame, mums: DataFrame, contigs: DataFrame, width: int = WIDTH) -> DataFrame:
    """mum_id, brk: whether a contig ends at this row of the chain ``rows`` (mum_id) in any genome: its end is a contig's
    end, or the next row lies in another contig."""
    found = _chain(rows, mums, contigs, width).select("mum_id", "brk")
    return rows.select("mum_id").join(found.hint("merge"), "mum_id", "left").select("mum_id", F.coalesce("brk", F.lit(False)).alias("brk"))


def _chain(rows: DataFrame, mums: DataFrame, contigs: DataFrame, width: int) -> DataFrame:
    """mum_id, brk (see :func:`contig_breaks`), fwd (forward everywhere), ends (array by genome) of the rows of the chain."""
    follow = with_next(rows.select("mum_id"), [], ["mum_id"], ["mum_id"], name="after", width=width)
    follow = follow.select("mum_id", F.col("after.mum_id").alias("after_id"))
    m = mums.join(follow.hint("merge"), "mum_id").select("mum_id", "after_id", "seq_idx", "strand", F.when(F.col("start") >= 0, F.col("start")).alias("start"), "length")
    n = with_next(m, ["seq_idx"], ["mum_id"], ["mum_id", "start"], width=width)
    n = n.withColumns({"end": F.col("start") + F.col("length"), "next_start": F.when(F.col("next.mum_id") == F.col("after_id"), F.col("next.start"))})
    at = locate(locate(n.drop("next", "length", "after_id"), contigs, "end", "e_"), contigs, "next_start", "n_")
    edge = F.col("start").isNotNull() & (F.col("e_contig_idx").isNull() | (F.col("e_rel") == 0))
    moved = F.col("start").isNotNull() & F.coalesce(F.col("e_contig_idx") != F.col("n_contig_idx"), F.lit(False))
    ends = F.transform(F.array_sort(F.collect_list(F.struct("seq_idx", "end"))), lambda x: x["end"])
    return at.groupBy("mum_id").agg(F.bool_or(edge | moved).alias("brk"), F.bool_and("strand").alias("fwd"), ends.alias("ends"))


def shred_cuts(rows: DataFrame, mums: DataFrame, contigs: DataFrame, size: int, width: int = WIDTH) -> DataFrame:
    """mum_id, ends (array by genome): rows of the chain after which all genomes are cut.

    A row cuts if a contig breaks there, or if it is forward everywhere and the genomes' mean distance from their last
    cut exceeds ``size``. Contig breaks cut whatever came before, so the chain falls into independent stretches; each is
    read row by row in one task that remembers the last cut only, starting from the ends of the row that closed the one
    before.
    """
    per = shared(_chain(rows, mums, contigs, width))
    seg = running_sum(per, [], ["mum_id"], F.col("brk").cast("bigint"), "upto", width).withColumn("seg", F.col("upto") - F.col("brk").cast("bigint"))
    steps = seg.select("seg", "mum_id", "fwd", "brk", "ends")
    opening = seg.where("brk").select((F.col("seg") + 1).alias("seg"), F.lit(-1).cast("bigint").alias("mum_id"), F.lit(True).alias("fwd"), F.lit(True).alias("brk"), "ends")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            out = []
            for stretch, mum, fwd, brk, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if stretch != now:
                    now, last = stretch, [0] * len(ends)
                if mum < 0:
                    last = [e or 0 for e in ends]
                    continue
                spans = [e - x for e, x in zip(ends, last, strict=True) if e is not None]
                if brk or (fwd and spans and sum(spans) > len(spans) * size):
                    last = [x if e is None else e for e, x in zip(ends, last, strict=True)]
                    out.append((mum, last))
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["mum_id", "ends"])

    ordered = steps.unionByName(opening).repartition("seg").sortWithinPartitions("seg", "mum_id")
    return ordered.mapInArrow(fold, "mum_id bigint, ends array<bigint>")


def shred_intervals(cuts: DataFrame, contigs: DataFrame, width: int = WIDTH) -> DataFrame:
    """seq_idx, cut_id, start, end: the strips of each genome; the last strip (cut_id -1) ends with the genome.

    Empty strips are left out; an inverted stretch may give a cut before the last one, whose strip is left out, too.
    """
    long = cuts.select("mum_id", F.posexplode("ends").alias("seq_idx", "end"))
    whole = contigs.groupBy("seq_idx").agg(F.sum("length").alias("end"))
    order = F.lit((1 << 60)).cast("bigint")
    every = long.select("seq_idx", F.col("mum_id").alias("o"), "end").unionByName(whole.select("seq_idx", order.alias("o"), "end")).unionByName(whole.select("seq_idx", F.lit(-1).cast("bigint").alias("o"), F.lit(0).cast("bigint").alias("end")))
    n = with_next(every, ["seq_idx"], ["o"], ["o", "end"], width=width).where("next is not null")
    out = n.select("seq_idx", F.when(F.col("next.o") == order, F.lit(-1)).otherwise(F.col("next.o")).alias("cut_id"), F.col("end").alias("start"), F.col("next.end").alias("end"))
    return out.where("end > start")
