"""Importance resampling towards a target by hashed n-gram features.

A text's features are all its runs of one to three words; each falls into one of ``BUCKETS`` by the CRC32 of its bytes.
A bucket's gain is the scaled log ratio of its smoothed shares in the target and in the corpus, a document's weight the
sum over its features, and its score the weight with Gumbel noise that depends on its id alone: the highest scores are a
draw without replacement with probabilities in proportion to the weights' exponentials.

A chunk of texts has an integer dictionary: distinct words become ids, runs of words become tuples of ids (a pair is a
first and a second id, a triple a pair's number and a third id), and only distinct tuples are hashed, each once: a tuple's
bytes are a shorter tuple's with a blank and one word more, so its CRC goes on from there. Their numbers of occurrences
are joined back for the counts, and their gains for the weights. What leaves a task are 10,000 sums, and only the gains
(10,000 numbers) are sent to executors. Ranks are counted within ranges of scores, so no task sorts more than its range.

Defined results: null and empty texts have no features, weight 0 and are never drawn; a null id counts as the empty text
in the noise and sorts after all ids; repeated rows are documents of their own and are drawn one by one, equal ones
with successive ranks; an empty target has no features (all t are 0); an empty corpus gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .common import cut, tidy

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text that share a dictionary.
CHUNK = 4 << 20


class Grams:
    """Distinct runs of words of a chunk: their buckets and counts, and which of them starts where.

    ``of[k]`` is a triple for runs of k + 1 words: bucket and count of each distinct run, and for every occurrence (in
    order of its row) its number and row.
    """

    def __init__(self, w: tk.Words):
        _, first, ids = np.unique(w.hashes(), return_index=True, return_inverse=True)
        size = len(first)
        text = [w.text(i) for i in first.tolist()]
        more = [b" " + t for t in text]
        self.of, run, row = [], ids, w.row
        for k in range(LONGEST):
            if k:
                stays = np.flatnonzero(w.row[: len(w) - k] == w.row[k:]) if len(w) > k else np.zeros(0, np.int64)
                code = run[np.searchsorted(at, stays)] * size + ids[stays + k]
                tuples, run = np.unique(code, return_inverse=True)
                before, last = np.divmod(tuples, size) if size else (tuples, tuples)
                crc = [zlib.crc32(more[b], crc[a]) for a, b in zip(before.tolist(), last.tolist(), strict=True)]
                at, row = stays, w.row[stays]
            else:
                at, crc = np.arange(len(w)), [zlib.crc32(t) for t in text]
            bucket = (np.array(crc, np.int64) % BUCKETS).astype(np.int64)
            self.of.append((bucket, np.bincount(run, minlength=len(bucket)), run, row))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of features in each bucket, over all rows of the one column of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for w in tk.tokenize(b.column(0), tk.NOT_ALNUM, size=CHUNK):
                for bucket, often, _, _ in Grams(w).of:
                    np.add.at(total, bucket, often)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    got = texts.mapInArrow(tidy(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in got.collect():  # a row for each bucket
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, for every bucket."""
    t, s = float(target.sum() + BUCKETS), float(corpus.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((a + 1.0) * s / ((b + 1.0) * t))) for a, b in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w in tk.tokenize(b.column(1), tk.NOT_ALNUM, size=CHUNK):
                features, weight = np.zeros(w.rows, np.int64), np.zeros(w.rows, np.int64)
                for bucket, _, run, row in Grams(w).of:
                    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
                    features += np.bincount(row, minlength=w.rows)
                    if len(row):
                        weight[row[begin]] += np.add.reduceat(gain[bucket[run]], begin)
                out.append((w.counts(), features, weight))
            cols = [np.concatenate([o[i] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], names=["doc_id", "n_words", "n_features", "weight"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.mapInArrow(tidy(run), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with each row's number (from 1) by ``order``: rows are dealt by ranges, whose sizes give each its start."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    start = dict(zip(sorted(sizes), np.concatenate([[0], np.cumsum([sizes[k] for k in sorted(sizes)])]).tolist()[:-1], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            if len(b):
                first = start[b.column(b.num_columns - 1)[0].as_py()] + done + 1
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.arange(first, first + len(b)))], names=[*b.schema.names[:-1], name])
                done += len(b)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return placed.mapInArrow(run, f"{fields}, `{name}` bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1; null where not drawn); one row for each document."""
    gain = gains(bucket_counts(target.select("text")), bucket_counts(docs.select("text")))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weights(docs, gain).withColumn("score", F.col("weight") + noise).withColumn("out", F.col("n_words") < least_words))
    drawn = scored.where("not out").count() * percent // 100
    ranks = numbered(scored, [F.asc("out"), F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    return ranks.select("doc_id", "n_features", "weight", "score", F.when(~F.col("out") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))
