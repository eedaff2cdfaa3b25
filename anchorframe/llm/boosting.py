"""Gradient-boosted regression trees for two classes (histograms, level-wise, array code)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    start: float
    cuts: list[np.ndarray]
    feature: np.ndarray  # trees x inner nodes, in heap order; -1 sends everything left
    bin: np.ndarray
    value: np.ndarray  # trees x leaves

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = np.zeros(x.shape, np.int64)
        for j in np.unique(self.feature[self.feature >= 0]):  # only what a tree looks at
            b[:, j] = np.searchsorted(self.cuts[j], x[:, j], "right")
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.bin, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + ((f[at] >= 0) & (b[rows, f[at]] >= t[at]))
            out += v[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 1.0) -> Forest:
    mean = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    wide = max(len(c) for c in cuts) + 1
    b = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], 1)
    n, k = x.shape
    flat = b + np.arange(k) * wide
    logit = np.full(n, start)
    inner = 2**depth - 1
    feature, at_bin, value = np.full((trees, inner), -1), np.zeros((trees, inner), np.int64), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            own = at - first
            where = (own[:, None] * (k * wide) + flat).ravel()
            size = 2**level * k * wide
            hg = np.bincount(where, np.repeat(g, k), size).reshape(-1, k, wide)
            hh = np.bincount(where, np.repeat(h, k), size).reshape(-1, k, wide)
            lg, lh = np.cumsum(hg, 2)[:, :, :-1], np.cumsum(hh, 2)[:, :, :-1]
            tg, th = hg.sum(2)[:, :1, None], hh.sum(2)[:, :1, None]
            gain = lg**2 / (lh + ridge) + (tg - lg) ** 2 / (th - lh + ridge) - tg**2 / (th + ridge)
            gain[(lh < least) | (th - lh < least)] = 0
            gain = gain.reshape(len(gain), -1)
            best = gain.argmax(1)
            good = gain[np.arange(len(gain)), best] > 1e-6
            feature[t, first : first + len(best)] = np.where(good, best // (wide - 1), -1)
            at_bin[t, first : first + len(best)] = best % (wide - 1) + 1
            f = feature[t, at]
            at = 2 * at + 1 + ((f >= 0) & (b[np.arange(n), f] >= at_bin[t, at]))
        leaf = at - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        logit += value[t][leaf]
    return Forest(start, cuts, feature, at_bin, value)
