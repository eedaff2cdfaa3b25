"""Shingle sets, SetSketch registers and their joint likelihood (array code)."""

from __future__ import annotations

import numpy as np

from . import textkit as tk

SHINGLE, BANDS, ROWS = 5, 40, 4
REGISTERS = BANDS * ROWS
#: Register scale: x is exponential with rate RATE per element; a register holds floor(1 - log_BASE(min x)), truncated.
BASE, RATE, TOP = 1.001, 20.0, 65535

_rng = np.random.Generator(np.random.PCG64(77))
_MULT = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def shingles(w: tk.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's rows, ordered by (row, hash), their rows, and each row's bounds.

    A row with fewer than k words (but some) has its whole word sequence as its one shingle.
    """
    h, n = w.hashes(), w.counts()
    g, ok = tk.windows(h, w.row, k)
    at = np.flatnonzero(ok)
    short = np.flatnonzero((n > 0) & (n < k))
    x = np.concatenate([g[at], tk.span_hash(h, w.first[short], w.first[short + 1])])
    row = np.concatenate([w.row[at], short])
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    x, row = x[new], row[new]
    return x, row, np.searchsorted(row, np.arange(w.rows + 1))


def registers(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of every row that has elements; zeros elsewhere."""
    out = np.zeros((len(bounds) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out
    at = bounds[full]
    low = np.empty((len(full), REGISTERS), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(REGISTERS):
            v = x * _MULT[j] + _ADD[j]
            low[:, j] = np.minimum.reduceat(v ^ (v >> np.uint64(29)), at)
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    least = -np.log1p(-u) / RATE
    out[full] = np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 1, TOP).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.full((len(regs), BANDS), 1469598103934665603, np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            key = tk.mix(key ^ r[:, :, j]) + np.uint64(j)
    return key


def log_ratio(equal, above, below, na, nb, at: float):
    """log likelihood of the best Jaccard similarity minus that of ``at``, from how many registers of a are equal to,
    above, or below those of b, given the set sizes.

    With u, v, j the shares of the union that only a, only b, and both hold, a register of a exceeds b's with
    probability close to u, falls short with v, and equals it with j (BASE is close to 1).
    """
    na, nb = np.asarray(na, float), np.asarray(nb, float)

    def fit(j):
        # shares implied by the sizes: |union| = (na + nb) / (1 + j)
        union = (na + nb) / (1 + j)
        u, v = (union - nb) / union, (union - na) / union
        tiny = 1e-3
        return equal * np.log(np.clip(j, tiny, 1)) + above * np.log(np.clip(u, tiny, 1)) + below * np.log(np.clip(v, tiny, 1))

    grid = np.linspace(0.2, 1.0, 17)  # a coarse best only keeps more pairs
    most = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    best = np.full(na.shape, -np.inf)
    for j in grid:
        best = np.maximum(best, np.where(j <= most + 1e-9, fit(np.float64(j)), -np.inf))
    best = np.maximum(best, fit(most))
    return best - fit(np.minimum(at, most)), best
