"""Hashes of words and spans: inputs that agree under polynomial hashes must not agree, and nothing they decide may mix them up."""

import random

import numpy as np
import pyarrow as pa

from anchorframe.llm import decontaminate, katz, neardup, substrings, textkit

THUE = "".join("ab"[i.bit_count() % 2] for i in range(1024))
OTHER = THUE.translate(str.maketrans("ab", "ba"))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_words_and_spans():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["x", "yy", "z" * 12, "q" * 255, "q" * 256, "q" * 257, THUE, OTHER]) for _ in range(rng.randrange(60))) for _ in range(80)]
    w = next(textkit.tokenize(pa.array(texts), lower=False))
    lanes, known = [w.hashes(lane) for lane in (0, 1)], {}
    for i in range(len(w)):
        for lane, h in enumerate(lanes):
            assert known.setdefault((w.text(i), lane), h[i]) == h[i]
    assert len(set(known.values())) == len(known) == 16
    spans = textkit.Spans(lanes[0])
    for k in (1, 3, 5, 13, 35, 51):
        g, ok = textkit.windows(lanes[0], w.row, k)
        at = np.flatnonzero(ok)
        assert (g[at] == spans.of(at, at + k)).all()
        for i in at:
            assert known.setdefault(tuple(w.text(j) for j in range(i, i + k)), g[i]) == g[i]
    assert len(set(known.values())) == len(known)


def test_long_words():
    rng = random.Random(5)
    long = ["".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 9, 63, 64, 65, 300, 5000) for _ in range(40)]
    w = next(textkit.tokenize(pa.array([" ".join(long)])))
    assert len(set(w.hashes().tolist())) == len(set(w.hashes(1).tolist())) == len(set(long))
    x, longer = w.stems(5)
    assert longer.all() and len(set(x.tolist())) == len({t[:5] for t in long})


def test_sequences_of_two_words():
    one, two = (" ".join({"a": "left", "b": "right"}[c] for c in t) for t in (THUE, OTHER))
    w = next(textkit.tokenize(pa.array([one, two])))
    h = textkit.span_hash(w.hashes(), w.first[:-1], w.first[1:])
    assert h[0] != h[1]


def test_nothing_shared_is_nothing_removed(spark):
    same = " ".join(f"w{i}" for i in range(34))
    docs = frame(spark, [f"{same} {THUE}", f"{same} {OTHER}"])
    assert [r.res.n_removed for r in substrings.dedup_substrings(docs).collect()] == [0, 0]
    assert [r.res.n_removed for r in substrings.dedup_substrings(frame(spark, [f"{same} {THUE}", f"{same} {OTHER}", "", f"{same} {THUE}"])).orderBy("row.doc_id").collect()] == [35, 0, 0, 35]


def test_nothing_shared_is_no_link(spark):
    got = neardup.components_of(frame(spark, [THUE, OTHER, THUE])).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [0, 1, 0] and [r.kept for r in got] == [True, True, False]


def test_nothing_shared_is_no_hit(spark):
    bench = spark.createDataFrame([(1, OTHER)], "item_id bigint, text string")
    for size in (1 << 20, 1):
        got = decontaminate.decontaminate(frame(spark, [THUE, OTHER]), bench, block_bytes=size).orderBy("row.doc_id").collect()
        assert [r.res.n_hit for r in got] == [0, 1]


def test_different_words_are_counted_apart(spark):
    docs = frame(spark, [t for k in range(10) for t in (THUE, OTHER if k < 3 else THUE)])
    got = {r.doc_id: r for r in katz.digest(docs).collect()}
    train = [i for i, r in got.items() if not r.held_out]
    rare = sum(i in (1, 3, 5) for i in train)
    words = {"rare": rare, "often": len(train) - rare, "end": len(train)}
    base = lambda w: np.log10((words[w] + 0.1) / (2 * len(train) + 0.1 * 4))
    assert rare and all(abs(got[i].base_score - base("rare" if i in (1, 3, 5) else "often") - base("end")) < 1e-9 for i in got)


def test_equal_first_hashes_are_told_apart():
    c = decontaminate.Class(2, 2, np.zeros(0, np.uint64), *(np.array(x, np.uint64) for x in ([5, 5, 9], [1, 2, 3])), 2, np.array([0, 1, 2, 3]), np.array([0, 1, 2]))
    x, y = (np.array(v, np.uint64) for v in ([5, 5, 5, 9, 9, 1], [1, 2, 3, 3, 1, 1]))
    assert decontaminate.same_window(c, x, y).tolist() == [0, 1, -1, 2, -1, -1]
