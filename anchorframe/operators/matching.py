"""Exact matches between sequences, from shared k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import runs
from ..functions.ordered import WIDTH, shared, with_next
from ..functions.suffixes import once_in_each_of


#: Characters of a piece: finding a position in a string takes time in proportion to it.
PIECE = 512
#: Letters of groups that are matched together, both strands counted.
LETTERS = 1 << 18


def kmers(seqs: DataFrame, k: int, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """keys, pos, kmer of every k-mer; a sequence is cut into overlapping pieces first."""
    s = seqs.where(F.length("seq") >= k).select(*keys, "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - k, F.lit(PIECE))).alias("base"))
    s = s.select(*keys, "base", F.substring("seq", F.col("base") + 1, F.lit(PIECE + k - 1)).alias("piece"))
    s = s.select(*keys, "base", "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - k + 1)).alias("at"))
    return s.select(*keys, (F.col("base") + F.col("at") - 1).cast("bigint").alias("pos"), F.substring("piece", F.col("at"), F.lit(k)).alias("kmer"))


def unique_anchors(seqs: DataFrame, k: int, genomes: int) -> DataFrame:
    """kmer, seq_id, pos of k-mers that occur exactly once in each of the sequences."""
    x = kmers(seqs, k)
    once = x.groupBy("kmer").agg(F.count("*").alias("m"), F.countDistinct("seq_id").alias("s")).where((F.col("m") == genomes) & (F.col("s") == genomes))
    return x.join(once.select("kmer"), "kmer").select("kmer", "seq_id", "pos")


def _maybe_in(right: DataFrame, k: int) -> np.ndarray:
    """A filter of the k-mers of ``right``: each task puts its own into pages, which are joined bit by bit."""
    bits = runs.bits_for(right.agg(F.sum(F.length("seq") - (k - 1))).first()[0] or 1)
    size = (1 << bits) // 8

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint8)
        for some in runs.joined((x,) for b in batches for x in b.column(0).to_pylist()):
            runs.add(own, [x for (x,) in some], k)
        used = np.flatnonzero(own.reshape(-1, runs.PAGE).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([own[runs.PAGE * i : runs.PAGE * (i + 1)].tobytes() for i in used], pa.binary())], names=["page", "bits"])

    made = right.select("seq").mapInArrow(pages, "page int, bits binary").groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))
    out = np.zeros(size, np.uint8)
    for page, x in made.collect():
        out[runs.PAGE * page : runs.PAGE * (page + 1)] = np.frombuffer(x, np.uint8)
    return out


def _stretches(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """seq_id, base, before, piece: of ``left`` the stretches whose k-mers may all occur on the right, in pieces as those of :func:`_pieces`."""
    sent = left.sparkSession.sparkContext.broadcast(_maybe_in(right, k))
    id_type = left.select("seq_id").schema["seq_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in runs.joined(zip(b.column(0), b.column(1).to_pylist(), strict=True)):
                out = []
                for i, start, end in runs.stretches(sent.value, [x for _, x in some], k):
                    key, x = some[i]
                    # letters beyond both ends of a stretch are left out: no match goes on there
                    out += [(key.as_py(), at, x[at - 1] if at > start else "", x[at : min(at + PIECE + k, end)]) for at in range(start, end - k + 1, PIECE)]
                cols = list(zip(*out, strict=True)) or [[]] * 4
                types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cols, types, strict=True)], names=["seq_id", "base", "before", "piece"])

    found = shared(left.select("seq_id", "seq").mapInArrow(run, f"seq_id {id_type.simpleString()}, base bigint, before string, piece string"))
    sent.destroy()
    return found


def _pieces(seqs: DataFrame, k: int) -> DataFrame:
    """seq_id, base, before, piece: PIECE k-mers from ``base`` on, the letter before them and one more behind them ('' at an end)."""
    s = seqs.select("seq_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - k, F.lit(PIECE))).alias("base"))
    before = F.when(F.col("base") > 0, F.substring("seq", F.col("base"), F.lit(1))).otherwise("")
    return s.select("seq_id", F.col("base").cast("bigint").alias("base"), before.alias("before"), F.substring("seq", F.col("base") + 1, F.lit(PIECE + k)).alias("piece"))


def _sides(pieces: DataFrame, k: int) -> DataFrame:
    """seq_id, pos, kmer, kind, side: of each k-mer the letter before (kind 0) and behind it (kind 1), '' at an end."""
    s = pieces.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("piece") - (k - 1)))).alias("at"))
    letter = lambda at: F.substring("piece", at, F.lit(1))
    sides = F.array(F.when(F.col("at") > 1, letter(F.col("at") - 1)).otherwise(F.col("before")), letter(F.col("at") + k))
    return s.select("seq_id", (F.col("base") + F.col("at") - 1).alias("pos"), F.substring("piece", F.col("at"), F.lit(k)).alias("kmer"), F.posexplode(sides).alias("kind", "side"))


def pairwise_mems(left: DataFrame, right: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """a, b, a_pos, b_pos, length: maximal exact matches of at least ``k`` characters between the sequences of two tables.

    Of the left, only stretches go on whose k-mers may occur on the right. A match begins where a shared k-mer has different
    letters before it and ends where it has different ones behind, so k-mers meet those of the other side by that letter:
    pairs within a match are not made, however often both sides repeat a k-mer.
    """
    long = F.length("seq") >= k
    left, right = left.where(long), right.where(long)
    x = _sides(_stretches(left, right, k), k).withColumnsRenamed({"seq_id": "a", "pos": "a_pos"})
    y = _sides(_pieces(right, k), k).withColumnsRenamed({"seq_id": "b", "pos": "b_pos"})
    known = y.groupBy("kmer", "kind").agg(F.collect_set("side").alias("known"))
    # merges: the planner takes what is made of a small file for as small as the file and would broadcast it
    others = F.filter("known", lambda s: (s != F.col("own")) | (s == ""))
    x = x.withColumnRenamed("side", "own").join(known.hint("merge"), ["kmer", "kind"]).withColumn("side", F.explode(others))
    marks = x.join(y.hint("merge"), ["kmer", "kind", "side"]).select("a", "b", (F.col("a_pos") - F.col("b_pos")).alias("diag"), "a_pos", "kind")
    n = with_next(shared(marks), ["a", "b", "diag"], ["a_pos", "kind"], ["a_pos"], width=width).where("kind = 0")
    return n.select("a", "b", "a_pos", (F.col("a_pos") - F.col("diag")).alias("b_pos"), (F.col("next.a_pos") - F.col("a_pos") + k).alias("length"))


def multi_matches(seqs: DataFrame, group: str, k: int, both_strands: bool = False, palindromes: bool = True) -> DataFrame:
    """group, match, seq_idx, pos, length, strand: maximal matches of at least ``k`` characters that occur exactly once in
    each of a group's sequences (group, seq_idx, seq; null ones are absent). ``match`` numbers a group's matches from 0.

    With ``both_strands`` sequences are nucleic acids and occurrences on either strand count; a match that is its own reverse
    complement counts once for both, or without ``palindromes`` for each, so that it is never unique. A match may be unique though
    none of its k-mers is, so the suffixes of a group that repeats k-mers in all its sequences are sorted as a whole; other
    groups are matched many at a time. A task holds LETTERS or one group, some hundred bytes for each character. Groups
    are slices between neighbouring anchors, not genomes.
    """
    kind = seqs.schema[group].dataType.simpleString()
    strands = 2 if both_strands else 1

    def matched(keys: list, groups: list[list[tuple]], key_type: pa.DataType) -> pa.RecordBatch:
        rows = [sorted((i, x) for i, x in g if x is not None) for g in groups]
        found = once_in_each_of([[x.encode() for _, x in g] for g in rows], k, both_strands, palindromes)
        flat = [(key, m, g[j][0], p, n, f) for key, g, of in zip(keys, rows, found, strict=True) for m, (n, starts, forward) in enumerate(of) for j, (p, f) in enumerate(zip(starts, forward, strict=True))]
        cols = list(zip(*flat, strict=True)) or [[]] * 6
        types = [key_type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cols, types, strict=True)], names=[group, "match", "seq_idx", "pos", "length", "strand"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, groups, letters, key_type = [], [], 0, None
        for b in batches:
            key_type = b.schema.field(0).type
            for key, i, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not keys or keys[-1] != key:
                    if letters * strands >= LETTERS:
                        yield matched(keys, groups, key_type)
                        keys, groups, letters = [], [], 0
                    keys.append(key)
                    groups.append([])
                groups[-1].append((i, x))
                letters += len(x or "")
        if keys:
            yield matched(keys, groups, key_type)

    # a number of partitions is not coalesced: groups are small, but each takes a while
    n = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = seqs.select(group, F.col("seq_idx").cast("int").alias("seq_idx"), "seq").repartition(n, group).sortWithinPartitions(group)
    return own.mapInArrow(run, f"`{group}` {kind}, match bigint, seq_idx int, pos bigint, length bigint, strand boolean")
