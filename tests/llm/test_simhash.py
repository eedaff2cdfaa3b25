"""SimHash components against plain Python over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from anchorframe.llm import graph, queries, simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), f"{fps[k]:016x}", str(least.get(find(k)))) for k, (i, _) in enumerate(rows))


def texts():
    r = random.Random(3)
    v = [f"w{i}é" for i in range(60)] + ["Ö", "B", "a b"]
    base = [r.choice(v) for _ in range(400)]
    out = [None, "", " \n\t", "one", "One\ttwo", "one two", "one two three", " ".join(base), " ".join(base * 40)]
    for _ in range(60):
        t = list(base)
        for _ in range(r.choice([1, 1, 2, 6])):
            t[r.randrange(400)] = r.choice(v)
        out.append(r.choice([" ", "  ", "\n"]).join(t))
    return out + [" ".join(r.choice(v) for _ in range(r.choice([3, 5, 90]))) for _ in range(40)] + out[7:12]


def test_fingerprints():
    t = texts()
    assert simhash.fingerprints(pa.array(t)).tolist() == [plain(x) for x in t]
    assert simhash.fingerprints(pa.array([], pa.string())).tolist() == []


def test_close_pairs_of_groups_of_many_sizes():
    rng = np.random.default_rng(2)
    for shape, bits in (([2, 1, 3, 0, 2], 2), ([700, 3, 64, 65, 128], 9), ([300], 5)):
        sizes = np.array(shape)
        v, g = rng.integers(0, 1 << bits, sizes.sum()).astype(np.uint16), np.repeat(np.arange(len(sizes)), sizes)
        for radius in (0, 1, 2, 3):
            i, j = simhash.close_pairs(v, sizes, 16, radius)
            far = np.array([[int(a ^ b).bit_count() for b in v] for a in v])
            want = {(a, b) for a, b in zip(*np.nonzero((far <= radius) & (g[:, None] == g[None, :])), strict=True) if a < b}
            got = [(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)]
            assert len(got) == len(want) and set(got) == want


def test_links_of_every_pair_of_bits(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(4)]
    near = [base[0] ^ 1 << a ^ 1 << b for a in range(64) for b in range(a, 64)]
    far = [base[1] ^ 7, base[1] ^ 1 << 63 ^ 1 << 31 ^ 1]
    fps = sorted(set(base + near + far))
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    got = {v: c for v, c in simhash.components(simhash.linked(frame)).collect()}
    mine = {f: got.get(f - (1 << 64) if f >> 63 else f) for f in fps}
    assert len({mine[f] for f in [base[0], *near]}) == 1 and mine[base[0]] is not None
    assert all(mine[f] is None for f in base[1:] + far)


def test_components(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(None, rows[7][1]), (None, "nobody else has this"), (9, "one two"), (9, rows[20][1]), (-5, None)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id bigint, text string, fp int, component_id int")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.components_of(docs).collect())
    want = brute(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 20
    assert simhash.components_of(docs.limit(0)).count() == 0
    nothing = simhash.components_of(docs.where("text is null")).collect()
    assert {(r.fingerprint, r.component_id) for r in nothing} == {("0" * 16, -5)}


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts()[::-1])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_simhash"](spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == brute(rows)


def test_rounds_on_a_long_path(spark, monkeypatch):
    """A path takes many rounds of joins; the planner's sizes must not grow with them."""
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    r = random.Random(5)
    names = list(range(700))
    r.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(699) if i != 350] + [(5000, 5001)]
    got = dict(graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    want = {v: min(part) for part in (names[:351], names[351:], [5000, 5001]) for v in part}
    assert got == want
