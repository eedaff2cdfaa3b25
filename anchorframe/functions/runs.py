"""Where runs of ``k`` letters of some texts may occur in others: a Bloom filter over their hashes (array code).

The filter knows no false negatives; what it lets through is to be compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bits of a filter, as powers of two: at least and at most (0.5 and 16 MB). So many bits for each run, between the two.
LEAST, MOST, BITS = 22, 27, 32
#: Bytes of a page, as which parts of a filter are put together.
PAGE = 4096
#: Letters that are hashed at a time, so that they stay in the processor's cache, and texts that are joined for it.
BLOCK, JOINED = 1 << 16, 1 << 20

_BASE = 0x9E3779B97F4A7C15
_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def bits_for(runs: int) -> int:
    """The size of a filter for so many runs, as a power of two."""
    return min(max(LEAST, (BITS * runs - 1).bit_length()), MOST)


def hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` codes; runs of 1, 2, 4, ... codes are joined."""
    part, size, out, done = codes.astype(np.uint64), 1, None, 0
    while True:
        if k & size:
            n = max(len(codes) - done - size + 1, 0)
            out = part if out is None else out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[done : done + n]
            done += size
        if 2 * size > k:
            return out
        part = part[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2


def _slots(h: np.ndarray, bits: int, i: int) -> np.ndarray:
    return ((h * _ODD[i]) >> np.uint64(64 - bits)).view(np.int64)


def _blocks(texts: list[str], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, hashes) of blocks of the joined texts; runs over the end of a text are among them."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    for at in range(0, len(codes) - k + 1, BLOCK):
        yield at, hashes(codes[at : at + BLOCK + k - 1], k)


def add(filter_: np.ndarray, texts: list[str], k: int) -> None:
    """Puts the runs of all texts into a filter (an array of bytes)."""
    bits = (8 * len(filter_)).bit_length() - 1
    for _, h in _blocks(texts, k):
        for i in range(len(_ODD)):
            at = np.unique(_slots(h, bits, i))
            np.bitwise_or.at(filter_, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def stretches(filter_: np.ndarray, texts: list[str], k: int) -> list[tuple[int, int, int]]:
    """(text, start, end) of the longest stretches of which every run of ``k`` letters may be in the filter."""
    bits = (8 * len(filter_)).bit_length() - 1
    found = []
    for at, h in _blocks(texts, k):
        places = None
        for i in range(len(_ODD)):
            slot = _slots(h if places is None else h[places], bits, i)
            hit = np.flatnonzero(filter_[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            places = hit if places is None else places[hit]
        found.append(places + at)
    place = np.concatenate(found) if found else np.zeros(0, np.int64)
    ends = np.cumsum([len(x) for x in texts])
    own = np.searchsorted(ends, place, "right")
    inside = place + k <= ends[own]
    place, own = place[inside], own[inside]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place))[: len(first)] - 1
    base = np.append(0, ends)[own[first]]
    return list(zip(own[first].tolist(), (place[first] - base).tolist(), (place[last] + k - base).tolist(), strict=True))


def joined(texts: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Tuples that end with a text, in lists of some JOINED letters."""
    held, letters = [], 0
    for x in texts:
        held.append(x)
        letters += len(x[-1])
        if letters >= JOINED:
            yield held
            held, letters = [], 0
    if held:
        yield held
