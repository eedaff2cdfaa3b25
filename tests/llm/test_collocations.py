"""Collocations against plain Python: odd rows, hot pivots, chunks of any size."""

import random
import re
from collections import Counter

import pytest

from anchorframe.llm import collocations, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, first=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + k])] += 1
    by_lang = {}
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        if len(p) == 2 and any(100 * b >= 50 * a for (other, q), b in f.items() if other == lang and len(q) == 3 and b >= least and p in (q[:2], q[1:])):
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang, found in by_lang.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def table():
    r = random.Random(12)
    v = ["the", "The", "of", "new", "york", "city", "Übung", "übung", "x", "a\x0bb", "q?r", "\x1f"] + [f"w{i}" for i in range(3)]
    mixed = [(i, "".join(r.choice(v) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "; "]) for _ in range(r.choice([1, 2, 3, 40, 120]))), r.choice(["en", "de", None, "", "und"])) for i in range(250)]
    fixed = [(100, "the new york city of the new york. " * 12, "en"), (101, "a a a a b a a " * 9, "de"), (102, "of the " * 300, None), (None, "lone pair here " * 5, "fr")]
    return mixed + fixed + [(200, None, "en"), (201, "", None), (202, " \t.,", "xx"), fixed[0], fixed[3], fixed[3]]


def rows_of(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


@pytest.mark.parametrize("size, hot", [(6 << 20, 1 << 22), (300, 25)])
def test_collocations(spark, size, hot):
    rows = table()
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id bigint, text string, lang string, n int, phrase int").repartition(3)
    want = brute(rows)
    assert len(want) > 100 and {r[0] for r in want} >= {"en", "de", "und", ""}
    assert rows_of(collocations.collocations(docs, size=size, hot=hot)) == want
    few = brute(rows, first=7)
    assert rows_of(collocations.collocations(docs, first=7, size=size, hot=hot)) == few and len(few) < len(want)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_large_numbers_are_exact(spark):
    big = 1_500_000_000_000
    docs = spark.createDataFrame([("en", "x")], "lang string, text string")
    counts = spark.createDataFrame([("en", "", 9 * big), ("en", "a", 3 * big + 7), ("en", "b", 2 * big + 1), ("en", "a b", big + 3)], "lang string, phrase string, a bigint")
    made = collocations.counts
    try:
        collocations.counts = lambda *a, **k: counts
        (r,) = collocations.collocations(docs).collect()
    finally:
        collocations.counts = made
    assert r.score == 1000000 * (big + 3) ** 2 // ((3 * big + 7) * (2 * big + 1)) and (r.l, r.r, r.n) == (3 * big + 7, 2 * big + 1, 9 * big)


def test_query(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(queries.QUERIES["op12_collocations"](spark, str(tmp_path))) == brute(rows)


def test_counting_stays_where_fragments_are(spark):
    docs = spark.createDataFrame(table()[:20], "doc_id bigint, text string, lang string")
    plan = collocations.counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") and plan.count("Exchange hashpartitioning(key") == plan.count("Generate")


def test_fragments_are_made_once(spark):
    """Chunks were rewritten twice, once for pivots of one share and once for dealt ones; now in one branch."""
    docs = spark.createDataFrame([("en", "a b c " * 20)], "lang string, text string")
    from anchorframe.llm import collocations

    plan = collocations.counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1
