"""Vectorised tokenising and hashing of whole Arrow text columns.

Words are delimited by ASCII bytes only, so all work is done on UTF-8 bytes. A word's hash takes in eight bytes at a
time with a full mix after each (words above LONG bytes are hashed by BLAKE2b); a span's hash joins the hashes of its
pieces of 1, 2, 4, ... words, again with a mix at each joint, so a window of k words costs about 2 log k array operations.
Nothing is a plain polynomial, whose values agree for whole families of inputs. Two lanes with different seeds give 128
bits. Texts are handled in chunks of about a megabyte (a longer text is its own chunk), which bounds memory whatever the
batch size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

#: Words above so many bytes are hashed one by one.
LONG = 256
#: Seeds and odd multipliers of the two lanes.
_SEED = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BELOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all 64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _byte_set(*spans: tuple[int, int]) -> np.ndarray:
    x = np.zeros(256, bool)
    for a, b in spans:
        x[a : b + 1] = True
    return x


#: Separator bytes of ``[^\x20\x09-\x0D]+``.
SPACE = _byte_set((0x20, 0x20), (0x09, 0x0D))
#: Separator bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_ALNUM = _byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


@dataclass
class Words:
    """Words of rows ``lo`` to ``hi`` of a column; ``row`` counts from ``lo``."""

    lo: int
    hi: int
    data: np.ndarray  # bytes, lower-cased if asked for
    offs: np.ndarray  # row offsets in data
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # index of each row's first word; one more entry than rows

    def __len__(self) -> int:
        return len(self.start)

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lane: int = 0) -> np.ndarray:
        return byte_hash(self.data, self.start, self.end - self.start, lane)

    def stems(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the first ``size`` bytes of each longer word, and which words are longer."""
        longer = self.end - self.start > size
        a = self.start[longer]
        return byte_hash(self.data, a, np.full(len(a), size)), longer

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def byte_hash(data: np.ndarray, start: np.ndarray, size: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` bytes from ``start``."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from every place
    with np.errstate(over="ignore"):
        h = mix((_SEED[lane] + size.astype(np.uint64) * _STEP[lane]) ^ (eight[start] & _BELOW[np.minimum(size, 8)]))
        more, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(more):
            piece = eight[start[more] + done] & _BELOW[np.minimum(size[more] - done, 8)]
            h[more] = mix(h[more] * _STEP[lane] + piece)
            done += 8
            more = more[size[more] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=16).digest()
        h[i] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return h


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    big = pa.types.is_large_string(col.type)
    _, o, d = col.buffers()
    if len(col) == 0 or o is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(o, np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8)[offs[0] : offs[-1]] if d is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def tokenize(
    col: pa.Array, separators: np.ndarray = SPACE, lower: bool = True, size: int = CHUNK
) -> Iterator[Words]:
    data, offs = column_bytes(col)
    for lo, hi in chunks(offs, size):
        d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        yield words(LOWERED[d] if lower else d, o, separators, lo)


def words(d: np.ndarray, o: np.ndarray, separators: np.ndarray, lo: int = 0) -> Words:
    inside = ~separators[d]
    edge = np.zeros(len(d) + 1, bool)
    edge[o] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    begin = np.searchsorted(start, o)
    row = np.repeat(np.arange(len(o) - 1), np.diff(begin))
    return Words(lo, lo + len(o) - 1, d, o, start, end, row, begin)


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive entries of ``h``, by first entry, and whether they lie in one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return Spans(h).windows(k), row[:n] == row[k - 1 :]


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring pieces from theirs; their order matters."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


class Spans:
    """Hashes of any runs of ``h``, from those of all its runs of 1, 2, 4, ... entries (made when first needed)."""

    def __init__(self, h: np.ndarray):
        self.levels = [h]

    def level(self, j: int) -> np.ndarray:
        while len(self.levels) <= j:
            x, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(join(x[: len(x) - half], x[half:]))
        return self.levels[j]

    @staticmethod
    def seed(size):
        with np.errstate(over="ignore"):
            return mix(np.asarray(size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, k: int) -> np.ndarray:
        """All runs of ``k`` entries, by first entry."""
        n, at = len(self.levels[0]) - k + 1, 0
        out = np.broadcast_to(self.seed(np.array([k])), n)
        for j in reversed(range(k.bit_length())):
            if k >> j & 1:
                out = join(out, self.level(j)[at : at + n])
                at += 1 << j
        return out

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The runs from ``a`` up to ``b``."""
        size = b - a
        out = self.seed(size)
        if not len(size):
            return out
        at = np.array(a, np.int64)
        for j in reversed(range(int(size.max()).bit_length())):
            use = np.flatnonzero(size >> j & 1)
            if len(use):
                out[use] = join(out[use], self.level(j)[at[use]])
                at[use] += 1 << j
        return out


def span_hash(h: np.ndarray, a: np.ndarray, b: np.ndarray, s: Spans | None = None) -> np.ndarray:
    """Hash of the word sequences ``h[a:b]``."""
    return (Spans(h) if s is None else s).of(a, b)


def member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Position of each x in the sorted ``table``, or -1."""
    if not len(table):
        return np.full(len(x), -1)
    i = np.searchsorted(table, x)
    i[i == len(table)] = 0
    return np.where(table[i] == x, i, -1)


def uniq_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (a, b), ordered."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]
