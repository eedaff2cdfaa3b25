"""Training-data operators against plain Python on small tables with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import unicodedata  # noqa: F401
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from anchorframe.llm import boosting, decontaminate, fingerprint, graph, htmltext, katz, linededup, mixing, neardup, quality, setsketch, substrings, textkit, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t, lower=False):
    t = t or ""
    return WORD.findall(t.translate(LOW) if lower else t)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    v = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    base = [r.choice(v) for _ in range(90)]
    out = [(i, " ".join(base[:k] + [r.choice(v)] + base[k + 1 :]).replace(" ", "\n", 3), f"s{i % 3}") for i, k in enumerate([3, 40, 41, 80, 88, 12])]
    out += [(10 + i, "\n".join(" ".join(r.choice(v) for _ in range(r.choice([1, 2, 5, 30]))) for _ in range(r.choice([1, 3, 6]))), r.choice(["s0", "s1", None])) for i in range(20)]
    out += [(40, None, "s1"), (41, "", "s1"), (42, " \n\t", None), (43, "one two", "s2"), (44, "one two", "s2"), (45, " ".join(base * 30), "s0"), (10, out[-1][1], "s0"), (None, out[0][1], "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, 7, 8) for x in rows], "doc_id bigint, text string, source string, n_words int, res int").cache()


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string")


def test_tokens_and_windows(rows):
    col = pa.array([t for _, t, _ in rows])
    seen = {}
    for size in (64, 1 << 20):
        for w in textkit.tokenize(col, size=size):
            for i, h in enumerate(w.hashes()):
                assert seen.setdefault(w.text(i), h) == h
            g, ok = textkit.windows(w.hashes(), w.row, 3)
            for i in np.flatnonzero(ok):
                assert seen.setdefault(tuple(w.text(j) for j in range(i, i + 3)), g[i]) == g[i]
        assert [n for w in textkit.tokenize(col, size=size) for n in w.counts()] == [len(words(t, True)) for _, t, _ in rows]
    assert len(set(seen.values())) == len(seen)


def test_decontaminate(spark, docs, rows):
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: alnum.findall((t or "").translate(LOW))
    items = [(1, " ".join(cut(rows[0][1])[20:50])), (2, "one two"), (3, None), (4, ""), (20, " ".join(cut(rows[9][1])[:14])), (None, "w5 w6"), (7, "one two")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wins = [(i, tuple(w[k : k + min(13, len(w))])) for i, t in items if (w := cut(t)) for k in range(len(w) - min(13, len(w)) + 1)]
    for size in (1 << 20, 100):
        got = decontaminate.decontaminate(docs, bench, block_bytes=size).collect()
        assert len(got) == len(rows)
        for g in got:
            w, hit, ids = cut(g.row.text), set(), set()
            for i, t in wins:
                for k in range(len(w) - len(t) + 1):
                    if tuple(w[k : k + len(t)]) == t:
                        hit |= set(range(k, k + len(t)))
                        ids |= {i} - {None}
            assert (g.res.n_words, g.res.n_hit, g.res.item_ids) == (len(w), len(hit), sorted(map(str, ids)))
            assert g.row.n_words == 7
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("res.n_hit > 0").count() == 0


def test_chunk_boundaries_are_local(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    shared = [f"line {r.random()}" for _ in range(60)]
    texts = ["\n".join([f"own {i} {k}" for k in range(r.randint(0, 5))] + shared + [f"end {i} {k}" for k in range(r.randint(0, 4))]) for i in range(8)] + ["one", "", "a\nb", "\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    lines = F.split("t", "\n", -1)
    got = {x.i: x.ends for x in df.select("i", linededup.chunk_ends(F.transform(lines, linededup.line_number)).alias("ends")).collect()}
    within = set()
    for i, t in enumerate(texts):
        ls = t.split("\n")
        a = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
        prop = [(31 * (a[k - 1] if k else 0) + a[k]) % linededup.DIVISOR == 0 for k in range(len(ls))]
        want = [k + 1 for k in range(len(ls)) if k == len(ls) - 1 or (0 < k < len(ls) - 2 and prop[k] and not prop[k - 1])]
        assert got[i] == want
        assert len(ls) < 2 or min(np.diff([0, *want])) >= 2
        if i < 8:
            at = ls.index(shared[0])
            within.add(tuple(e - at for e in want if 2 < e - at < 58))
    assert len(within) == 1  # the shared passage is cut alike wherever it stands


def test_line_runs_match_brute_force(spark, docs):
    r = random.Random(6)
    line = [f"line {i}" for i in range(400)]
    run = [line[:2], line[2:9], line[9:12], ["only", ""]]
    rows = [(None, None), (90, ""), (91, " \n\n "), (92, "line 2")]
    for i in range(30):
        parts = [[x] for x in r.sample(line[20:], 4)] + [p for p in run if r.random() < 0.4] + [r.sample(line[2:9], 1)] + [["é x", "é x", "é x"]] * (i == 4)
        r.shuffle(parts)
        rows.append((i, "\n".join(x for p in parts for x in p)))
    seen, want = set(), []
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        if t is None:
            want.append((d, None, 0, 0))
            continue
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - 1):
            pair = tuple(lines[i : i + 2])
            if "".join(pair).strip():
                gone |= {i, i + 1} if pair in seen else set()
                seen.add(pair)
        want.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(x.doc_id, x.text, x.n_lines, x.n_removed) for x in linededup.digest(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[3] for x in want) > 50
    twice = [(5, "a\nb"), (5, "a\nb")]
    assert [x.n_removed for x in linededup.digest(spark.createDataFrame(twice, df.schema)).collect()] == [0, 0]
    assert linededup.dedup_lines(docs).count() == docs.count() and linededup.dedup_lines(empty(spark)).count() == 0
    odd = df.selectExpr("*", "1 as d", "2 as h", "3 as keys", "4 as gone", "5 as s", "6 as res", "7 as row")
    assert linededup.dedup_lines(odd).select("row.*").columns == odd.columns
    big = "\n".join(f"line {i % 4000}" for i in range(8000))
    long = linededup.digest(spark.createDataFrame([(1, big), (2, big)], df.schema)).collect()
    assert [x.n_removed for x in sorted(long)] == [4000, 8000]


def test_near_duplicates(spark, docs, rows):
    def shingles(t):
        w = words(t, True)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    nodes = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, (a, s) in enumerate(nodes):
        for b, t in nodes[:x]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    for block in (1024, 3):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.components_of(docs, block).collect()), key=str)
        assert got == sorted(((i, len(shingles(t)), None if i is None else find(i)) for i, t, _ in rows), key=str)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert neardup.components_of(empty(spark)).count() == 0


def test_pairs_just_above_the_threshold_are_found(spark):
    """Recall of pairs with a similarity of 0.75 to 0.8, and none below the threshold."""
    r = random.Random(9)
    rows, near = [], {}
    for k in range(300):
        base = [f"t{r.randrange(50_000)}" for _ in range(160)]
        other = list(base)
        for at in r.sample(range(0, 160, 8), r.choice([4, 5, 6])):
            other[at] = f"x{k}.{at}"
        a, b = ({tuple(w[i : i + 5]) for i in range(156)} for w in (base, other))
        near[2 * k] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    got = {x.doc_id: x.component_id for x in neardup.components_of(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    close = [i for i, j in near.items() if 0.75 <= j <= 0.8]
    assert len(close) > 50 and all(got[i + 1] == i for i in close)
    assert all((got[i + 1] == i) == (j >= 0.75) for i, j in near.items())


def test_components_without_single_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 40), (40, 60), (7, 7)], "a bigint, b bigint")
    got = {r.v: r.c for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 60: 40, 100: 40}


def test_registers_estimate_similarity():
    x = np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(x[:2000]), np.sort(x[500:2500])
    r = setsketch.registers(np.concatenate([a, b]), np.array([0, 2000, 4000]))
    assert abs((r[0] == r[1]).mean() - 0.6) < 0.2
    both = setsketch.registers(np.sort(x[:2500]), np.array([0, 2500]))
    assert (both[0] == np.maximum(r[0], r[1])).all()  # mergeable


def test_fingerprint(spark, docs, rows):
    df = docs.where("doc_id is not null").select("doc_id", "text")
    got = fingerprint.digest(df).collect()
    order = sorted(((i, t or "") for i, t, _ in rows if i is not None))
    want = []
    for k, (i, t) in enumerate(order):
        h = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - h] + order[(k + 1) % len(order)][1][:h]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    from pyspark.sql import functions as F

    v = fingerprint.vector
    # the edited text's fingerprint, which the query derives from the text's, is that of the edited text
    edits = [(k, t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]) for k, (_, t) in enumerate(order)]
    direct = {r.t: r.f for r in spark.createDataFrame(edits, "k int, t string").select("t", fingerprint.to_string(v(F.col("t"))).alias("f")).collect()}
    by = {(r.doc_id, r.edited_sha256): r for r in got}
    for k, t in edits:
        r = by[order[k][0], hashlib.sha256(t.encode()).hexdigest()]
        assert r.edited_fingerprint == direct[t]
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    # likeness against the share of common sentences
    r = random.Random(3)
    pool = [f"Sentence {i} says {r.random()}." for i in range(4000)]
    pairs = [(s / 10, " ".join(pool[k * 60 : k * 60 + 30]), " ".join(pool[k * 60 : k * 60 + 3 * s] + pool[k * 60 + 30 : k * 60 + 60 - 3 * s])) for k, s in enumerate([0, 2, 5, 8, 10] * 12)]
    frame = spark.createDataFrame(pairs, "s double, a string, b string")
    near = [(x.s, x.n) for x in frame.select("s", fingerprint.likeness(v(F.col("a")), v(F.col("b"))).alias("n")).collect()]
    assert all(abs(s - n) < 0.4 for s, n in near) and sum(abs(s - n) for s, n in near) / len(near) < 0.1
    assert fingerprint.digest(df.limit(0)).count() == 0
    loose = spark.createDataFrame([(None, "a"), (None, "b\nc"), (3, None), (2, "d")], "doc_id bigint, text string")
    order3 = ["a", "b\nc", "d", ""]
    assert sorted(x.edited_sha256 for x in fingerprint.digest(loose).collect()) == sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + order3[(k + 1) % 4][: len(t) // 2]).encode()).hexdigest() for k, t in enumerate(order3))
    one = spark.range(1).select(
        (v(F.lit("a\nb. c\nd")) == v(F.lit("d\na\nb. c"))).alias("order"),
        (fingerprint.combine(v(F.lit("a\nb")), v(F.lit("c"))) == v(F.lit("a\nb\nc"))).alias("insert"),
        (fingerprint.subtract(v(F.lit("a\nb\nc")), v(F.lit("b"))) == v(F.lit("a\nc"))).alias("delete"),
        (v(F.lit("a\nb")) == v(F.lit("a\nc"))).alias("other"),
    ).first()
    assert (one.order, one.insert, one.delete, one.other) == (True, True, True, False)


def test_mixing(spark, docs, rows):
    got = mixing.digest(docs).collect()
    assert len(got) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), 1.5 * sum(sizes.values())
    while True:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: weight[s] * share for s in open_}
    by = mixing.targets(docs.select("source", mixing.size_of().alias("size"))).collect()
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in by)
    again = mixing.digest(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    many = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "if(id % 3 = 0, 'a', 'b') as source")
    out = mixing.digest(many).groupBy("target").agg({"taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 50 for r in out)
    assert mixing.digest(empty(spark)).count() == 0


def test_substrings(spark, docs, rows):
    count = Counter()
    for _, t, _ in rows:
        w = words(t)
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for i, t, _ in rows:
        w = words(t)
        gone = {k for p in range(len(w) - 34) if count[tuple(w[p : p + 35])] > 1 for k in range(p, p + 35)}
        want.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(str(r.row.doc_id), r.res.n_words, r.res.n_removed, r.res.text) for r in substrings.dedup_substrings(docs).collect()]
    assert sorted(got) == sorted(want)
    assert substrings.dedup_substrings(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [None, 20])
def test_katz_is_normalised_and_exact(spark, docs, rows, monkeypatch, hot):
    monkeypatch.setattr(katz.chunked, "__defaults__", (2000,))
    got = {(r.doc_id, r.n_tokens): r for r in katz.score(docs, hot_tokens=hot).collect()}
    toks = [(i, words(t, True) + ["</s>"]) for i, t, _ in rows]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in toks}
    padded = [(i, ["<s>", "<s>", *w]) for i, w in toks]
    uni, bi, tri, h1, h2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, w in padded:
        if not held[i]:
            uni.update(w[2:])
            bi.update(zip(w[1:], w[2:], strict=False))
            tri.update(zip(w, w[1:], w[2:], strict=False))
            h1.update(w[1:-1])
            h2.update(zip(w[:-2], w[1:-1], strict=True))
    if hot:
        assert max(h1.values()) > hot and max(h2.values()) > hot  # words and pairs that are spread over partitions
    n = sum(uni.values())
    d1, d2, d3 = (katz.discounts(katz.counts_of_counts(np.array(list(c.values())))) for c in (uni, bi, tri))
    d = lambda t, c: t[c] if c <= katz.FEW else 1.0
    p1 = lambda w: d(d1, uni[w]) * uni[w] / n if uni[w] else 1 - sum(d(d1, c) * c for c in uni.values()) / n
    after1, after2 = {}, {}
    for (x, y), c in bi.items():
        after1.setdefault(x, {})[y] = c
    for (x, y, z), c in tri.items():
        after2.setdefault((x, y), {})[z] = c

    def back_off(h, w, count, after, disc, lower):
        if not count[h]:
            return lower(w)
        f = after[h]
        left = sum((1 - d(disc, c)) * c for c in f.values())
        total, left = (count[h] + 1, 1) if left <= 0 else (count[h], left)
        return d(disc, f[w]) * f[w] / total if w in f else left / total / (1 - sum(lower(y) for y in f)) * lower(w)

    p2 = lambda h, w: back_off(h, w, h1, after1, d2, p1)
    p3 = lambda g, h, w: back_off((g, h), w, h2, after2, d3, lambda y: p2(h, y))
    g, h = max(h2, key=h2.get)
    assert abs(sum(p3(g, h, w) for w in uni) + p3(g, h, None) - 1) < 1e-9
    for i, w in toks[:4] + toks[20:30]:
        r = got[i, len(w)]
        want = sum(np.log10(p3(*x)) for x in zip(["<s>", "<s>", *w[:-2]], ["<s>", *w[:-1]], w, strict=False))
        assert abs(r.score - want) < 1e-6 * (1 + abs(want))
        assert abs(r.base_score - sum(np.log10((uni[x] + 0.1) / (n + 0.1 * (len(uni) + 1))) for x in w)) < 1e-6 * (1 + abs(r.base_score))
        assert (r.held_out, r.n_known, r.train_tokens) == (held[i], sum(uni[x] > 0 for x in w), n)
    assert len(got) == len({(i, len(w)) for i, w in toks})
    assert katz.score(empty(spark)).count() == 0


def test_katz_leaves_other_queries_alone(spark, docs):
    """Other queries of the session that run beside the scoring keep their right results."""
    from concurrent.futures import ThreadPoolExecutor

    def other(k):
        out = spark.range(300_000).selectExpr(f"id % {700 + k} as g", "id as x").groupBy("g").sum("x").groupBy().sum("sum(x)").first()[0]
        return out == 300_000 * 299_999 // 2

    with ThreadPoolExecutor(4) as pool:
        scored = [pool.submit(lambda: katz.score(docs).count()) for _ in range(2)]
        assert all(pool.map(other, range(12)))
        assert {s.result() for s in scored} == {docs.count()}


def test_classifiers_learn_and_survive_odd_tables(spark, docs):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        bad, toxic = i % 4 == 0, i % 5 == 0
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(40)]
        if bad:
            w = [x + "***" for x in w]
        if toxic:
            w[r.randrange(40)] = r.choice(["vileword", "meanword"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    df, lb = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for out, col in ((quality.digest(df, lb), 1), (toxicity.digest(df, lb), 2)):
        got = out.collect()
        held = [x for x in got if x.held_out]
        assert held and sum(x.predicted == labels[x.doc_id][col] for x in held) >= 0.95 * len(held)
    none = lb.limit(0)
    assert quality.digest(docs, none).count() == docs.count() and toxicity.digest(docs, lb).count() == docs.count()
    assert quality.digest(empty(spark), lb).count() == 0 and toxicity.digest(empty(spark), none).count() == 0
    clean = toxicity.keep_clean(docs, lb)
    assert clean.columns == docs.columns


def test_toxicity_learns_from_ten_thousand_labels(spark):
    df = spark.range(24_000).selectExpr("id as doc_id", "concat('w', id % 50, ' v', id % 2) as text")
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    assert 9_500 < toxicity.train(df, labels).learned < 10_500
    assert toxicity.train(df, labels, size=20_000).learned < 6_000  # a bound on bytes, too
    assert toxicity.train(df, labels.unionByName(labels)).learned < 10_500  # repeated labels count once


def test_boosting():
    x = np.random.default_rng(0).normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert (((boosting.fit(x, y).logit(x) > 0) == y).mean()) > 0.95


def test_html(spark):
    page = (
        "<html><head><title>no</title><style>p{}</style><script>var a='<p>x</p>'</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>More</a></li></ul></nav>"
        "<div class='ad'>Buy this now.</div><article><h1>The &amp; title</h1><p><b>First \n  part.<br>Next &#233;.<p>Second, longer part of it all.</p></article>"
        "<div class='comments'><p>Reader says this is fine.</p></div><footer>&copy; someone</footer>"
    )
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", page)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.digest(df).collect()}
    text = "The & title\nFirst part. Next é.\nSecond, longer part of it all."
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0), 4: (text, len(text))}
    assert htmltext.digest(df.limit(0)).count() == 0
    rnd = random.Random(123)
    good = 0
    for _ in range(60):
        nodes, x = htmltext.features(htmltext.parse(htmltext.training_page(rnd), marks=True), htmltext.model().meaning)
        want = [n.text for n in nodes if n.tag == "#text" and n.mark == 1]
        good += htmltext.decode(nodes, htmltext.model().logit(x)) == want
    assert good >= 40


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing here")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = docs.select("doc_id", "text", "source").selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as bigint) as n_chars")
    own.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    out = p.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and all(r.copies in (1, 2) for r in out)
