"""Exact matches that occur once in each of several short sequences (array code): for one group by a suffix array, for many
groups together by their runs of ``least`` letters."""

from __future__ import annotations

import numpy as np

# Complements of the letters of nucleic acids.
_PAIR = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")


def reverse_complement(seq: bytes) -> bytes:
    return seq.translate(_PAIR)[::-1]


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the length each shares with the one before it (0 for the first), by prefix doubling."""
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    levels, step = [rank.astype(np.int64)], 1
    order = np.argsort(rank, kind="stable")
    while levels[-1].max(initial=0) < n - 1:
        rank = levels[-1]
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        key = rank * (n + 1) + later + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        levels.append(new)
        step *= 2
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        equal = np.zeros(len(a), bool)
        equal[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        # ranks of the last level are all different, so only true prefixes agree
        common += equal * (1 << level)
        a, b = a + equal * (1 << level), b + equal * (1 << level)
    shared[1:] = common
    return order, shared


def once_in_each(seqs: list[bytes], least: int, both_strands: bool, palindromes: bool = True) -> list[tuple[int, list[int], list[bool]]]:
    """(length, starts, forward?) of maximal matches of ``least`` letters or more that occur exactly once in each sequence.

    With ``both_strands`` occurrences on either strand count, starts are those on the forward strand, and a match is given
    as it reads forward in the first sequence; one that is its own reverse complement counts once, as forward, or without
    ``palindromes`` as what it is on two strands, twice, and is left out.
    """
    n = len(seqs)
    if n < 2 or min(map(len, seqs)) < least:
        return []
    texts = list(seqs) + ([reverse_complement(s) for s in seqs] if both_strands else [])
    size = sum(map(len, texts)) + len(texts)
    codes, owner, place, strand = np.zeros(size, np.int64), np.full(size, -1), np.zeros(size, np.int64), np.ones(size, bool)
    at = 0
    for i, t in enumerate(texts):
        codes[at : at + len(t)] = np.frombuffer(t, np.uint8)
        codes[at + len(t)] = 256 + i  # every end differs from all else, so no match runs over it
        owner[at : at + len(t)] = i % n
        place[at : at + len(t)] = np.arange(len(t))
        strand[at : at + len(t)] = i < n
        at += len(t) + 1
    order, shared = suffix_array(codes)
    before = np.where(order > 0, codes[order - 1], -1)
    length = np.array([len(s) for s in seqs])
    out = []
    for m in (n, 2 * n) if both_strands and palindromes else (n,):
        if m > size:
            continue
        long = np.lib.stride_tricks.sliding_window_view(shared[1:], m - 1).min(1)  # what m neighbours share
        first = np.arange(size - m + 1)
        ok = (long >= least) & (shared[first] < long) & (np.append(shared, 0)[first + m] < long)
        for i in first[ok]:
            rows, n_chars = order[i : i + m], int(long[i])
            own, fwd = owner[rows], strand[rows]
            starts = np.where(fwd, place[rows], length[own] - place[rows] - n_chars)
            if m == n:
                if len(np.unique(own)) < n or (before[i : i + m] == before[i]).all() or not fwd[own == 0][0]:
                    continue
            elif not all(len(np.unique(starts[own == j])) == 1 and (own == j).sum() == 2 and fwd[own == j].sum() == 1 for j in range(n)):
                continue  # only a match that is its own reverse complement stands on both strands of one place
            else:
                left, right = codes[rows[fwd] - 1] if rows[fwd].min() else np.arange(n), codes[rows[fwd] + n_chars]
                if (left == left[0]).all() or (right == right[0]).all():
                    continue
            by = np.lexsort((~fwd, own))[:: m // n]
            out.append((n_chars, starts[by].tolist(), fwd[by].tolist()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _packed(data: np.ndarray, least: int) -> tuple[np.ndarray, int]:
    """The first letters of every suffix as a number, and how many letters that is: at most ``least``, as many as fit."""
    there = np.bincount(data, minlength=256) > 0
    letters = (np.cumsum(there) - 1).astype(np.int64)[data]
    bits = max(1, (int(there.sum()) - 1).bit_length())
    word = min(least, 62 // bits)
    packed = np.zeros(len(data), np.int64)
    for i in range(word):
        packed <<= bits
        packed[: len(data) - i] |= letters[i:]
    return packed, word


def once_in_each_of(groups: list[list[bytes]], least: int, both_strands: bool, palindromes: bool = True) -> list[list[tuple[int, list[int], list[bool]]]]:
    """:func:`once_in_each` of every group, for many groups at once.

    What is shared by all sequences of a group begins with ``least`` letters that all of them have. Where these stand once
    in each, the match begins there and only its length is open. A group in which such letters are repeated may have
    matches that are unique though none of their runs is, so it is sorted as a whole.
    """
    found: list[list[tuple[int, list[int], list[bool]]]] = [[] for _ in groups]
    use = [g for g, seqs in enumerate(groups) if len(seqs) > 1 and min(map(len, seqs)) >= least]
    if not use:
        return found
    texts, labels = [], []
    for j, g in enumerate(use):
        for i, s in enumerate(groups[g]):  # both strands of a sequence side by side, so rows of a class are in its order
            texts.append(s)
            labels.append((j, i, True))
            if both_strands:
                texts.append(reverse_complement(s))
                labels.append((j, i, False))
    group, owner, forward = (np.array(x) for x in zip(*labels, strict=True))
    genomes = np.array([len(groups[g]) for g in use])
    data, length = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    begin = np.cumsum(length) - length
    text = np.repeat(np.arange(len(texts)), length)
    left = (begin + length)[text] - np.arange(len(data))
    packed, word = _packed(data, least)
    at = np.flatnonzero(left >= least)
    key = packed[at]
    if word < least:
        ranks = np.unique(packed, return_inverse=True)[1]
        key = ranks[at]
        for off in (*range(word, least - word, word), least - word):
            key = np.unique(key * (int(ranks.max()) + 1) + ranks[at + off], return_inverse=True)[1]
    if (int(key.max()) + 1) * len(use) >= 1 << 63:
        key = np.unique(key, return_inverse=True)[1]
    key = group[text[at]] * (int(key.max()) + 1) + key
    order = np.argsort(key, kind="stable")
    key, place = key[order], at[order]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    own = owner[text[place]]
    owners = np.add.reduceat(new | np.append(True, own[1:] != own[:-1]), first, dtype=np.int64)
    lead = text[place[first]]
    n = genomes[group[lead]]
    repeated = np.zeros(len(use), bool)
    repeated[group[lead[(owners == n) & (size > n)]]] = True
    plain = (owners == n) & (size == n) & forward[lead] & ~repeated[group[lead]]
    for m in np.unique(n[plain]):
        rows = place[first[plain & (n == m)][:, None] + np.arange(m)]
        before = np.where(left[rows] == length[text[rows]], -1 - np.arange(m), data[rows - 1])
        rows = rows[(before != before[:, :1]).any(1)]
        long, room = np.full(len(rows), least), left[rows].min(1)
        for values, step in ((packed, word), (data, 1)):
            more = np.flatnonzero(room >= long + step)
            while len(more):
                ahead = values[rows[more] + long[more, None]]
                more = more[(ahead == ahead[:, :1]).all(1)]
                long[more] += step
                more = more[room[more] >= long[more] + step]
        which, fwd = text[rows], forward[text[rows]]
        starts = rows - begin[which]
        starts = np.where(fwd, starts, length[which] - starts - long[:, None])
        for g, *match in zip(group[which[:, 0]].tolist(), long.tolist(), starts.tolist(), fwd.tolist(), strict=True):
            found[use[g]].append(tuple(match))
    for g in np.flatnonzero(repeated).tolist():
        found[use[g]] = once_in_each(groups[use[g]], least, both_strands, palindromes)
    return [sorted(x, key=lambda y: (y[1], y[0])) for x in found]
