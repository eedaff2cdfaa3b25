"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from anchorframe.llm import importance, queries, textkit

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def buckets(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, bench):
    s, t = (Counter(b for x in texts for b in buckets(x)) for texts in ([x for _, x in rows], bench))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10_000.0) / ((s[b] + 1.0) * (big_t + 10_000.0)))) for b in range(10_000)]
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = buckets(x)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    can = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(can[: 5 * len(can) // 100], 1):
        rank.setdefault(tuple(r), []).append(k)
    return sorted((str(r[0]), r[1], r[2], r[3], str(rank[tuple(r)].pop() if rank.get(tuple(r)) else None)) for r in out)


def table():
    r = random.Random(6)
    v = [f"w{i}" for i in range(80)] + ["Ünder", "naïve", "WORD", "x1y"]
    rows = [(i, r.choice([" ", ", ", "-\n"]).join(r.choice(v) for _ in range(r.choice([1, 2, 3, 19, 20, 60, 200])))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " .,;"), (None, rows[5][1]), (None, rows[6][1] * 9), (903, " ".join(v * 300)), rows[9], rows[9]]
    return rows, [" ".join(r.choice(v[:30]) for _ in range(40)) for _ in range(12)] + [None, ""]


def got(frame):
    return sorted((str(r.doc_id), r.n_features, r.weight, r.score, str(r["rank"])) for r in frame.collect())


def frames(spark, rows, bench):
    return spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id bigint, text string, score int, rank int"), spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id int, text string")


def test_distinct_runs_are_hashed_once():
    rows, _ = table()
    for size in (100, 1 << 20):
        mine = []
        for w in textkit.tokenize(pa.array([t for _, t in rows]), textkit.NOT_ALNUM, size=size):
            g = importance.Grams(w)
            each = [[] for _ in range(w.rows)]
            for bucket, often, run, row in g.of:
                assert often.sum() == len(run) and (often > 0).all()
                for b, k in zip(bucket[run].tolist(), row.tolist(), strict=True):
                    each[k].append(b)
            mine += each
        assert mine == [buckets(t) for _, t in rows]


def test_resample(spark):
    rows, bench = table()
    docs, target = frames(spark, rows, bench)
    want = brute(rows, bench)
    assert got(importance.resample(docs, target)) == want
    assert sum(r[4] != "None" for r in want) >= 5
    assert importance.resample(docs.limit(0), target).count() == 0


@pytest.mark.parametrize("bench", [[], [None], ["w1 w2"]])
def test_small_targets(spark, bench):
    rows = table()[0][:60]
    docs, target = frames(spark, rows, bench)
    assert got(importance.resample(docs, target)) == brute(rows, bench)


def test_query(spark, tmp_path):
    rows, bench = table()
    docs, target = frames(spark, rows, bench)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    target.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert got(queries.QUERIES["op13_importance"](spark, str(tmp_path))) == brute(rows, bench)
