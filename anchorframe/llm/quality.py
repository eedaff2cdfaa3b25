"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics are binned; cyclic boosting fits, feature after feature and round after round, a tree of at most four
leaves over one feature's bins to the current gradient and adds it, shrunk, to that feature's lookup table. Then the
pairs whose grid lowers the loss most get two-dimensional tables in the same way. A score is the logistic function of
the sum of the looked-up entries, so scoring is a few array additions per document.

Labels are learned from a bounded sample: at most ``sample`` labelled rows, chosen by a hash of doc_id, whose feature
vectors (not texts) go to the driver. All documents are scored.

Defined results: null text is empty text and gets a score like any other; null labels are ignored; without labels of
both kinds the score is their (smoothed) mean, 0.5 without any; repeated rows get equal scores; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .common import cut, remainder, unit

SAMPLE, BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 20_000, 48, 150, 0.12, 8, 8, 40
THRESHOLD = 0.3

_UPPER = tk._byte_set((65, 90))
_ALPHA = tk._byte_set((65, 90), (97, 122))
_DIGIT = tk._byte_set((48, 57))
_HIGH = tk._byte_set((128, 255))
_PUNCT = ~(_ALPHA | _DIGIT | _HIGH | tk.SPACE)
_NOISE = np.zeros(256, bool)
_NOISE[[ord(c) for c in "*#$%&|!@^~<>{}[]\\=+_/"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True

FEATURES = [
    "log_words", "log_bytes", "word_length", "word_length_sd", "upper", "digit", "punct", "noise", "high", "odd_ends", "stops_ends", "single",
    "distinct", "repeat_next", "distinct_2", "distinct_4", "lines", "line_length", "line_repeat", "long_words", "top_word", "caps_words", "mixed_words", "mean_run",
]


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the count of the most frequent one, by row."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(r)))
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, r[at], runs)
    return np.bincount(r[at], minlength=rows), most


def features(w: tk.Words) -> np.ndarray:
    """Statistics of each row of a chunk (of unchanged case), in the order of FEATURES."""
    rows, n, o, d = w.rows, w.counts(), w.offs, w.data
    size = np.diff(o)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[o])
    some, bytes_, word = np.maximum(n, 1), np.maximum(size, 1), lambda x: np.bincount(w.row, x, rows)
    length = (w.end - w.start).astype(float)
    h = w.hashes()
    last = d[w.end - 1] if len(w) else np.zeros(0, np.uint8)
    first = d[w.start] if len(w) else np.zeros(0, np.uint8)
    mean = word(length) / some
    distinct, most = _distinct(w.row, h, rows)
    same = np.zeros(len(w), bool)
    same[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    grams = []
    for k in (2, 4):
        g, ok = tk.windows(h, w.row, k)
        r = w.row[: len(g)][ok]
        grams.append((_distinct(r, g[ok], rows)[0] + 1) / (np.bincount(r, minlength=rows) + 1))
    lf = np.zeros(256, bool)
    lf[10] = True
    breaks = per(lf[d])
    lines = tk.words(d, o, lf)
    ld = _distinct(lines.row, lines.hashes(), rows)[0]
    ln = np.maximum(lines.counts(), 1)
    upper = _UPPER[d]
    ups = np.concatenate([[0], np.cumsum(upper)])
    alphas = np.concatenate([[0], np.cumsum(_ALPHA[d])])
    puncts = np.concatenate([[0], np.cumsum(_PUNCT[d])])
    wu, wa, wp = (x[w.end] - x[w.start] for x in (ups, alphas, puncts))
    return np.stack(
        [
            np.log1p(n), np.log1p(size), mean, np.sqrt(np.maximum(word(length**2) / some - mean**2, 0)), per(upper) / np.maximum(per(_ALPHA[d]), 1), per(_DIGIT[d]) / bytes_,
            per(_PUNCT[d]) / bytes_, per(_NOISE[d]) / bytes_, per(_HIGH[d]) / bytes_, word(_NOISE[last] | _NOISE[first]) / some, word(_STOP[last]) / some, word(length == 1) / some,
            distinct / some, word(same) / some, grams[0], grams[1], breaks / some, size / ln, ld / ln, word(length > 14) / some,
            most / some, word((wu == wa) & (wa > 1)) / some, word((wp > 1) & (wa > 0)) / some, per(tk.SPACE[d]) / some,
        ],
        1,
    ).astype(np.float32)


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and f (array<float>) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(w) for w in tk.tokenize(b.column(1), lower=False)]
            x = np.concatenate(x) if x else np.zeros((0, len(FEATURES)), np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, f array<float>")


@dataclass
class Model:
    start: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]  # features, their cuts, table

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += t[np.searchsorted(c, x[:, j], "right")]
        for i, j, ci, cj, t in self.pairs:
            out += t[np.searchsorted(ci, x[:, i], "right"), np.searchsorted(cj, x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32))


def _split(g: np.ndarray, h: np.ndarray, lo: int, hi: int, ridge: float, least: float):
    """Best cut of bins lo:hi and its gain."""
    cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
    if hi - lo < 2:
        return None, 0.0
    a, b, ga = ch[:-1], ch[-1] - ch[:-1], cg[:-1]
    gain = ga**2 / (a + ridge) + (cg[-1] - ga) ** 2 / (b + ridge) - cg[-1] ** 2 / (ch[-1] + ridge)
    gain[(a < least) | (b < least)] = 0
    k = int(np.argmax(gain))
    return (lo + k + 1, float(gain[k])) if gain[k] > 0 else (None, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0, least: float = 2.0, leaves: int = 4) -> np.ndarray:
    """Leaf value of each bin, of a tree of at most ``leaves`` leaves."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    while len(parts) < leaves:
        best = max(((*_split(g, h, lo, hi, ridge, least), lo, hi) for lo, hi in parts), key=lambda s: s[1])
        if best[0] is None:
            break
        parts.remove((best[2], best[3]))
        parts += [(best[2], best[0]), (best[0], best[3])]
    for lo, hi in parts:
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Best tree on a grid that cuts one axis, then both sides on the other; leaf values and gain."""
    best, value = 0.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for k in range(1, gg.shape[0]):
            v, total = np.zeros_like(gg), -gg.sum() ** 2 / (hh.sum() + ridge)
            for lo, hi in ((0, k), (k, gg.shape[0])):
                a, b = gg[lo:hi].sum(0), hh[lo:hi].sum(0)
                at, _ = _split(a, b, 0, len(a), ridge, 2.0)
                for s, e in ((0, at), (at, len(a))) if at else ((0, len(a)),):
                    w = -a[s:e].sum() / (b[s:e].sum() + ridge)
                    v[lo:hi, s:e] = w
                    total += a[s:e].sum() ** 2 / (b[s:e].sum() + ridge)
            if total > best:
                best, value = total, (v.T if flip else v)
    return value, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS) -> Model:
    mean = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(mean / (1 - mean)))
    if len(y) < 20 or y.min() == y.max():
        return Model(start, [np.zeros(0, np.float32)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    logit = np.full(len(y), start)
    for _ in range(rounds):
        for b, t in zip(bins, tables, strict=True):
            p = 1 / (1 + np.exp(-logit))
            step = rate * _tree(np.bincount(b, p - y, len(t)), np.bincount(b, p * (1 - p), len(t)))
            t += step
            logit += step[b]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cb = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]

    def grid(i, j):
        p = 1 / (1 + np.exp(-logit))
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        at = cb[i] * shape[1] + cb[j]
        size = shape[0] * shape[1]
        return np.bincount(at, p - y, size).reshape(shape), np.bincount(at, p * (1 - p), size).reshape(shape)

    gains = sorted(((_grid_tree(*grid(i, j))[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:pairs]
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for g, i, j in gains if g > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in chosen:
            step = rate * _grid_tree(*grid(i, j))[0]
            t += step
            logit += step[cb[i], cb[j]]
    return Model(start, cuts, tables, [(i, j, coarse[i], coarse[j], t) for i, j, t in chosen])


def sampled(rows: DataFrame, labels: DataFrame, target: str, held, bound: int, seed: int) -> DataFrame:
    """Rows with their label ``y``: about ``bound`` of those that may be learned from, chosen by a hash of doc_id.

    A doc_id with several label rows counts once, with their greatest value.
    """
    y = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(target).cast("double").alias("y"))
    y = y.where(~held).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = y.count()
    return rows.join(y.where(unit("doc_id", seed=seed) * n < bound), "doc_id")


def train(feats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    got = sampled(feats, labels, "quality", remainder(5) == 0, sample, 3).select("doc_id", "f", "y").toPandas()
    got = got.sort_values("doc_id")
    x = np.array(got["f"].tolist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy())


def score(feats: DataFrame, model: Model) -> DataFrame:
    sent = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(x))], names=["doc_id", "score"])

    return feats.mapInArrow(run, "doc_id bigint, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    feats = cut(feature_rows(docs))
    out = score(feats, train(feats, labels))
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
