"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features of a text are the hashes of its lower-cased words (as a whole, and longer ones cut to a stem), of neighbouring
pairs, and of pairs with one word between them, each present or absent; what fewer than LEAST_DOCS sampled documents
have is left out of training. FTRL-proximal keeps two numbers per coordinate (a summed gradient and a summed squared
gradient), which give every coordinate its own learning rate, and an L1 threshold that holds all coordinates without
evidence at exactly zero. The model that is broadcast is the list of its nonzero coordinates.

Labels are learned from a bounded sample: about ``sample`` labelled documents, and no more once their texts fill
SAMPLE_BYTES, chosen and ordered by hashes of doc_id. FTRL is sequential, so one executor task makes the sample's
features and fits; only the model (its nonzero coordinates) goes to the driver. All documents are scored, whole.

Defined results: null text is empty text and scores the bias; null labels are ignored; without labels the score is 0.5;
repeated rows get equal scores; null ids are scored; empty tables give empty results; :func:`keep_clean` keeps all
columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textkit as tk
from .common import map_rows, remainder, struct_array, tidy, unit
from .quality import sampled

SAMPLE, BITS, EPOCHS = 10_000, 22, 4
#: Bytes of sampled texts: bounds the training task where texts are long.
SAMPLE_BYTES = 256 << 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0
#: A word longer than so many bytes also counts under its first bytes, so inflected forms share evidence.
STEMS = (4, 5)
#: A coordinate enters training if so many sampled documents have it.
LEAST_DOCS = 3
THRESHOLD = 0.3


def coordinates(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every n-gram and skip-gram occurrence of a chunk."""
    h, top = w.hashes(), np.uint64((1 << BITS) - 1)
    out = [(w.row, tk.mix(h ^ np.uint64(0xA5A5)))]
    for size in STEMS:
        x, longer = w.stems(size)
        out.append((w.row[longer], tk.mix(x ^ np.uint64(0x7F4A + size))))
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
            if len(h) > gap:
                ok = w.row[gap:] == w.row[:-gap]
                out.append((w.row[gap:][ok], tk.mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(salt))[ok]))
    return np.concatenate([r for r, _ in out]), (np.concatenate([x for _, x in out]) & top).astype(np.int64)


@dataclass
class Model:
    bias: float
    at: np.ndarray  # sorted nonzero coordinates
    weight: np.ndarray
    learned: int = 0  # labels it was trained on

    def score(self, w: tk.Words) -> np.ndarray:
        row, x = coordinates(w)
        i = tk.member(x, self.at)
        row, i = tk.uniq_pairs(row[i >= 0], i[i >= 0])
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(row, self.weight[i], w.rows), -30, 30)))


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over the documents in the given order; each has the next ``counts`` distinct coordinates of x."""
    if not len(y):
        return Model(0.0, np.zeros(0, np.int64), np.zeros(0))
    docs = np.bincount(x, minlength=1 << BITS)
    known = np.flatnonzero(docs >= LEAST_DOCS)
    size = len(known)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(size)
    x = place[x]
    ends = np.cumsum(np.add.reduceat(np.append(x >= 0, False), np.minimum(np.cumsum(counts) - counts, len(x))) * (counts > 0))
    x = x[x >= 0]
    del docs, place
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    mean = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(mean / (1 - mean)))

    def weights(i, l1):
        v = z[i]
        return np.where(np.abs(v) <= l1, 0.0, -(v - np.sign(v) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    bias = np.array([size])
    for _ in range(epochs):
        for lo, hi, t in zip([0, *ends[:-1].tolist()], ends.tolist(), y, strict=True):
            own = x[lo:hi]
            w, b = weights(own, L1), weights(bias, 0.0)
            g = 1 / (1 + np.exp(-np.clip(prior + b[0] + w.sum(), -30, 30))) - t
            for i, v in ((own, w), (bias, b)):
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
                z[i] += g - sigma * v
                n[i] += g * g
    w = weights(slice(0, size), L1)
    at = np.flatnonzero(w)
    return Model(prior + float(weights(bias, 0.0)[0]), known[at], w[at])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, counts, y, left = [], [], [], size
        for b in batches:
            own, t = b.column(1), b.column(0).to_numpy()
            _, offs = tk.column_bytes(own)
            keep = int(np.searchsorted(offs, left, "right"))  # documents that begin within the bound
            left -= int(offs[min(keep, len(own))])
            y.append(t[:keep])
            for w in tk.tokenize(own.slice(0, keep), tk.NOT_ALNUM):
                row, x = tk.uniq_pairs(*coordinates(w))
                xs.append(x.astype(np.int32))
                counts.append(np.bincount(row, minlength=w.rows))
            if left < 0:
                break
        x, counts, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, counts, y))
        del xs
        m = fit(x, counts, y)
        yield pa.RecordBatch.from_arrays([pa.array([len(y)]), pa.array([m.bias]), pa.array([m.at.tobytes()], pa.binary()), pa.array([m.weight.tobytes()], pa.binary())], names=["n", "bias", "at", "weight"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chosen = sampled(texts, labels, "toxic", remainder(4) == 2, sample, 5).select("y", "text", unit("doc_id", seed=6).alias("u"), "doc_id")
    one = chosen.repartition(1).sortWithinPartitions("u", "doc_id", "text").select("y", "text")
    got = one.mapInArrow(tidy(run), "n bigint, bias double, at binary, weight binary").collect()  # one row, the model
    if not got:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return Model(got[0].bias, np.frombuffer(got[0].at, np.int64), np.frombuffer(got[0].weight, np.float64), got[0].n)


RESULT = T.StructType([T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Columns ``row`` and ``res.score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.StructArray) -> pa.StructArray:
        x = [sent.value.score(w) for w in tk.tokenize(rows.field(text_col), tk.NOT_ALNUM)]
        return struct_array({"score": pa.array(np.concatenate(x) if x else np.zeros(0))})

    return map_rows(docs, run, RESULT)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "text")
    out = score(own, train(docs, labels)).select("row.doc_id", "res.score")
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below ``threshold``, with all their columns."""
    return score(docs, train(docs, labels)).where(F.col("res.score") < threshold).select("row.*")
