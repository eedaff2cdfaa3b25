"""Suffix ranks and unique matches of sequences in pieces, against sorted strings and the one-task matcher."""

import glob
import random

import pytest

from anchorframe.functions.ordered import Scratch
from anchorframe.functions.suffixes import once_in_each
from anchorframe.operators import suffix_order

PAIR = str.maketrans("acgt", "tgca")


def cut(spark, groups, sizes=(5, 17, 40)):
    """Pieces of several lengths, in no order."""
    r, rows = random.Random(1), []
    for g, seqs in groups.items():
        for i, s in seqs.items():
            at = 0
            while at < len(s):
                n = r.choice(sizes)
                rows.append((g, i, at, s[at : at + n]))
                at += n
            if not s:
                rows.append((g, i, 0, ""))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "grp bigint, seq_idx int, at bigint, seq string")


def word(r, n, letters="acgt"):
    return "".join(r.choice(letters) for _ in range(n))


def test_ranks_and_common_prefixes(spark):
    r = random.Random(3)
    unit = word(r, 30)
    groups = {1: {0: unit * 4 + word(r, 20), 2: "a" * 70, 3: word(r, 9) + unit * 2}, 2: {0: word(r, 60, "ac"), 1: "c"}}
    scratch = Scratch(spark)
    pieces, _ = suffix_order.texts(cut(spark, groups), False, scratch)
    rows = suffix_order.suffixes(pieces).cache()
    text = {(g, i): s for g, seqs in groups.items() for i, s in seqs.items()}
    for x in rows.collect():
        s = text[x.grp, x.seq_idx]
        assert x.word == s[x.place : x.place + 8] and x.before == (ord(s[x.place - 1]) if x.place else -2 - 2 * x.seq_idx)
    order, levels = suffix_order.ranks(rows, scratch, width=16)
    order = order.cache()
    assert sorted((x.grp, x["rank"]) for x in order.collect()) == [(g, k) for g, seqs in groups.items() for k in range(sum(map(len, seqs.values())))]
    by = {(x.grp, x["rank"]): text[x.grp, x.seq_idx][x.place :] for x in order.collect()}
    shared = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    for g in groups:
        mine = [by[g, k] for k in range(len([1 for x in by if x[0] == g]))]
        for a, b, c in zip(mine, mine[1:], mine[2:], strict=False):
            assert shared(a, c) == min(shared(a, b), shared(b, c))  # neighbours share most: the order is one of prefixes
    got = {(x.grp, x["rank"]): x.lcp for x in suffix_order.common_prefixes(order, levels, rows, scratch, width=16).collect()}
    for (g, k), s in by.items():
        n = shared(by[g, k - 1], s) if k else 0
        assert got.get((g, k), 0) == (n if n >= 8 else 0)
    scratch.close()
    assert not glob.glob(f"{scratch.folder.removeprefix('file:')}*")


def groups_of_all_kinds():
    r = random.Random(5)
    base = word(r, 300)
    turned = base.translate(PAIR)[::-1]
    mutated = "".join(r.choice("acgt") if r.random() < 0.03 else c for c in base)
    own = word(r, 9)
    palindrome = own + own.translate(PAIR)[::-1]
    three = {0: base, 1: mutated, 2: word(r, 7) + base[150:] + base[:150]}
    return {
        1: three,
        2: {0: base, 3: turned, 4: mutated},
        3: {0: word(r, 40) + palindrome + word(r, 31), 1: word(r, 12) + palindrome + word(r, 50)},
        4: {0: base, 1: ""},
        5: {0: base},
        6: {0: "acgta" * 30, 1: "acgta" * 30 + "c"},
        7: {0: "a" * 100, 1: "a" * 100},
        8: {1: base + base[:80], 2: mutated},
        9: {0: word(r, 11), 1: base},
    }


@pytest.mark.parametrize("both, least, block", [(False, 12, 1 << 20), (True, 12, 64), (True, 5, 1 << 20)])
def test_unique_matches_equal_those_of_one_task(spark, both, least, block):
    groups = groups_of_all_kinds()
    got = sorted(tuple(x) for x in suffix_order.unique_matches(cut(spark, groups), least, both, block=block, width=64).select("grp", "match", "seq_idx", "pos", "length", "strand").collect())
    want = []
    for g, seqs in groups.items():
        present = sorted(i for i, s in seqs.items() if s)
        for m, (n, starts, forward) in enumerate(once_in_each([seqs[i].encode() for i in present], least, both)):
            want += [(g, m, i, p, n, f) for i, p, f in zip(present, starts, forward, strict=True)]
    assert got == sorted(want)
    assert {x[0] for x in want} >= ({1, 2, 3, 8} if both else {1, 8})


def test_no_sequences(spark):
    assert suffix_order.unique_matches(cut(spark, {1: {0: "acgtacgtacgt"}}), 8).count() == 0
    assert suffix_order.unique_matches(cut(spark, {1: {0: "acgtacgtacgt"}}).limit(0), 8).count() == 0
