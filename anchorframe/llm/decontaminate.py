"""Benchmark decontamination by winnowing.

Every item of ``window`` words or more contributes its windows of that many words; a shorter item is one window. For a
window length L the fingerprints are the k-word hashes (k = min(5, L)) that are minimal in some run of L - k + 1
consecutive k-word hashes. Any shared window holds exactly one such run, and what is minimal in it depends on the
window alone, so both sides keep a common fingerprint: every shared window is found, none is sampled. Fingerprints
shared with the benchmark are extended in both directions over all windows that contain them, and a window counts as a
hit only if its whole word sequence (128 bits: two hashes with different seeds) is one of the benchmark's.

A benchmark of at most ``block_bytes`` of text (its size is summed first) is sent to the executors, and the documents are
read once and never shuffled. A larger one stays a table: the documents' fingerprints meet the benchmark's by a shuffle,
texts that share any are fetched, and the windows around shared fingerprints are compared by another. Either way the
documents are read a fixed number of times, whatever the benchmark's size.

Defined results: null and empty texts have no words, no hits and are clean; null or empty items have no windows; rows
that share an item_id form one item, an item with a null id hits words but is not listed; equal document rows get
equal results; extra or clashing columns are carried in ``row`` untouched; empty tables give empty (or all-clean)
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textkit as tk
from .common import LOWER, UPPER, cut, map_rows, struct_array

WINDOW, K, BLOCK_BYTES = 13, 5, 24 << 20

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def minima(g: np.ndarray, ok: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Which k-gram hashes are minimal in some run of w consecutive ones of a row."""
    n = len(g) - w + 1
    keep = np.zeros(len(g), bool)
    if n <= 0:
        return keep
    low = g[:n].copy()
    for j in range(1, w):
        np.minimum(low, g[j : j + n], out=low)
    run = ok[:n] & ok[w - 1 :] & (row[:n] == row[w - 1 : w - 1 + n])
    for j in range(w):
        keep[j : j + n] |= run & (g[j : j + n] == low)
    return keep


@dataclass
class Class:
    """Windows of one length: their sorted hashes (of both lanes) with item lists, and the sorted fingerprints.

    Different windows of one first hash have entries of their own, as many as ``most`` in a row.
    """

    length: int
    k: int
    prints: np.ndarray
    hashes: np.ndarray
    again: np.ndarray
    most: int
    begin: np.ndarray
    items: np.ndarray


def build(ids: list[str | None], texts: list[str], window: int, k: int) -> tuple[list[str], list[Class]]:
    names = sorted({i for i in ids if i is not None})
    number = {n: j for j, n in enumerate(names)}
    mine = np.array([number.get(i, -1) for i in ids], np.int64)
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for w in tk.tokenize(pa.array(texts, pa.large_string()), tk.NOT_ALNUM):
        h, h2, n = w.hashes(), w.hashes(1), w.counts()
        for length in np.unique(np.minimum(n[n > 0], window)):
            rows = (n == length) if length < window else (n >= window)
            g, ok = tk.windows(h, w.row, int(min(k, length)))
            ok &= rows[w.row[: len(g)]]
            keep = minima(g, ok, w.row[: len(g)], int(length - min(k, length) + 1))
            x, whole = tk.windows(h, w.row, int(length))
            y, _ = tk.windows(h2, w.row, int(length))
            whole &= rows[w.row[: len(x)]]
            found.setdefault(int(length), []).append((g[keep], x[whole], mine[w.lo + w.row[: len(x)][whole]], y[whole]))
    out = []
    for length, parts in sorted(found.items()):
        prints, x, item, y = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((item, y, x))
        x, y, item = x[order], y[order], item[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        fresh = new.copy()
        fresh[1:] |= item[1:] != item[:-1]
        begin = np.append(np.flatnonzero(new[fresh]), fresh.sum())
        hashes = x[new]
        most = int(np.unique(hashes, return_counts=True)[1].max(initial=1))
        out.append(Class(length, min(k, length), np.unique(prints), hashes, y[new], most, begin, item[fresh]))
    return names, out


def same_window(c: Class, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Entry of each window, given both its hashes, or -1."""
    i = np.searchsorted(c.hashes, x)
    out = np.full(len(x), -1)
    for step in range(c.most):
        at = np.minimum(i + step, len(c.hashes) - 1)
        hit = (c.hashes[at] == x) & (c.again[at] == y)
        out[hit] = at[hit]
    return out


def search(w: tk.Words, classes: list[Class]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit words, and the distinct (row, item) pairs of a chunk."""
    m, h = len(w), w.hashes()
    spans, spans2 = tk.Spans(h), None
    cover = np.zeros(m + 1, np.int64)
    rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in classes:
        if m < c.length:
            continue
        g, ok = spans.windows(c.k), w.row[: m - c.k + 1] == w.row[c.k - 1 :]
        run = c.length - c.k + 1
        at = np.flatnonzero(minima(g, ok, w.row, run))
        at = at[tk.member(g[at], c.prints) >= 0]
        if not len(at):
            continue
        s = np.unique((at[:, None] - np.arange(run)[None, :]).ravel())
        s = s[(s >= 0) & (s + c.length <= m)]
        s = s[w.row[s] == w.row[s + c.length - 1]]
        x = spans.of(s, s + c.length)
        close = tk.member(x, c.hashes) >= 0
        s, x = s[close], x[close]
        if not len(s):
            continue
        spans2 = spans2 or tk.Spans(w.hashes(1))
        i = same_window(c, x, spans2.of(s, s + c.length))
        s, i = s[i >= 0], i[i >= 0]
        np.add.at(cover, s, 1)
        np.add.at(cover, s + c.length, -1)
        reps = c.begin[i + 1] - c.begin[i]
        flat = np.repeat(c.begin[i] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
        rows.append(np.repeat(w.row[s], reps))
        items.append(c.items[flat.astype(np.int64)])
    r, i = tk.uniq_pairs(np.concatenate(rows), np.concatenate(items))
    return np.cumsum(cover[:m]) > 0, r[i >= 0], i[i >= 0]


def _scan(docs: DataFrame, names: list[str], classes: list[Class], text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((names, classes))

    def run(rows: pa.StructArray) -> pa.StructArray:
        names, classes = sent.value
        label = np.array(names, object)
        n_words, n_hit, ids, spans = [], [], [], []
        for w in tk.tokenize(rows.field(text_col) if not rows.null_count else rows.flatten()[rows.type.get_field_index(text_col)], tk.NOT_ALNUM):
            hit, r, i = search(w, classes)
            n_words.append(w.counts())
            n_hit.append(np.add.reduceat(np.append(hit, 0).astype(np.int64), w.first[:-1]) * (w.counts() > 0) if w.rows else [])
            own_ids, own_spans = [[] for _ in range(w.rows)], [[] for _ in range(w.rows)]
            for a in np.unique(r):
                own_ids[a] = list(label[i[r == a]])
            for a in np.unique(w.row[hit]):
                x = np.diff(np.concatenate([[0], hit[w.first[a] : w.first[a + 1]].astype(np.int8), [0]]))
                own_spans[a] = np.stack([np.flatnonzero(x == 1), np.flatnonzero(x == -1)], 1).tolist()
            ids += own_ids
            spans += own_spans
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return struct_array({"n_words": pa.array(cat(n_words)), "n_hit": pa.array(cat(n_hit)), "item_ids": pa.array(ids, pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))})

    return map_rows(docs, run, RESULT)


def _merged(spans):
    """Sorted, disjoint [from, to) spans out of any spans."""
    step = F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<array<bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)[1] >= x[0]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], x[1]))))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(F.size(spans) > 0, step).otherwise(spans)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES, text_col: str = "text"
) -> DataFrame:
    """Columns ``row`` and ``res``: n_words, n_hit, item_ids (sorted as strings), spans of hit words [from, to)."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text") + F.lit(32))).first()[0] or 0
    if size <= block_bytes:
        got = bench.collect()  # at most block_bytes
        return _scan(docs, *build([r.id for r in got], [r.text for r in got], window, k), text_col)
    # Documents with equal texts have equal hits, so one of each text is searched.
    key = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    texts = docs.select(key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["key"])
    whole, prints = _benchmark_tables(bench, window, k)
    lengths = sorted(r.l for r in prints.select("l").distinct().collect())  # at most ``window``
    shared = _prints(texts, lengths, k).join(prints, ["l", "g"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("l", "g")).alias("prints"))
    near = cut(_near_windows(texts.join(shared, "key"), k).join(whole, ["l", "x", "y"]).select("key", "s", "l", "id").distinct())
    ids = near.where("id is not null").select("key", "id").distinct().groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("item_ids"))
    spans = near.select("key", F.array("s", F.col("s") + F.col("l")).alias("x")).distinct().groupBy("key").agg(_merged(F.collect_list("x")).alias("spans"))
    total = spans.join(ids, "key", "left")
    plain = _scan(docs, [], [], text_col).withColumn("key", key(F.col(f"row.`{text_col}`")))
    ids, spans = F.coalesce("item_ids", F.array().cast("array<string>")), F.coalesce("spans", F.array().cast("array<array<bigint>>"))
    hits = F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, x: acc + x[1] - x[0])
    return plain.join(total, "key", "left").select("row", F.struct(F.col("res.n_words").alias("n_words"), hits.alias("n_hit"), ids.alias("item_ids"), spans.alias("spans")).alias("res"))


def _benchmark_tables(bench: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (l, x, y, id) of all windows (x and y: both hashes), and distinct (l, g) of their fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, classes = build(b.column(0).to_pylist(), b.column(1).to_pylist(), window, k)
            for c in classes:
                reps = np.diff(c.begin)
                x, y = (np.repeat(v, reps).view(np.int64) for v in (c.hashes, c.again))
                label = pa.array([names[i] if i >= 0 else None for i in c.items], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c.length, np.int32)), pa.array(x), pa.array(y), label, pa.nulls(len(x), pa.int64())], names=["l", "x", "y", "id", "g"])
                n = len(c.prints)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c.length, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(c.prints.view(np.int64))], names=["l", "x", "y", "id", "g"])

    both = cut(bench.mapInArrow(run, "l int, x bigint, y bigint, id string, g bigint"))
    return both.where("x is not null").select("l", "x", "y", "id").distinct(), both.where("g is not null").select("l", "g").distinct()


def _prints(texts: DataFrame, lengths: list[int], k: int) -> DataFrame:
    """key, l, g: the distinct fingerprints of every text for each window length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in tk.tokenize(b.column(1), tk.NOT_ALNUM):
                h = w.hashes()
                for length in lengths:
                    g, ok = tk.windows(h, w.row, min(k, length))
                    at = np.flatnonzero(minima(g, ok, w.row, length - min(k, length) + 1))
                    row, x = tk.uniq_pairs(w.row[at], g[at])
                    keys = b.column(0).take(pa.array(row + w.lo))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(x), length, np.int32)), pa.array(x.view(np.int64))], names=["key", "l", "g"])

    return texts.select("key", "text").mapInArrow(run, "key string, l int, g bigint")


def _near_windows(texts: DataFrame, k: int) -> DataFrame:
    """key, l, x, y, s: the windows around the shared ``prints`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text, prints in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for w in tk.tokenize(pa.array([text], pa.large_string()), tk.NOT_ALNUM):
                    h, h2, m = w.hashes(), w.hashes(1), len(w)
                    for length in sorted({p["l"] for p in prints}):
                        own = np.sort(np.array([p["g"] for p in prints if p["l"] == length], np.int64).view(np.uint64))
                        g, ok = tk.windows(h, w.row, min(k, length))
                        run_ = length - min(k, length) + 1
                        at = np.flatnonzero(ok & (tk.member(g, own) >= 0))
                        s = np.unique((at[:, None] - np.arange(run_)[None, :]).ravel())
                        s = s[(s >= 0) & (s + length <= m)]
                        x, y = (pa.array(tk.span_hash(v, s, s + length).view(np.int64)) for v in (h, h2))
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(s)), pa.array(np.full(len(s), length, np.int32)), x, y, pa.array(s)], names=["key", "l", "x", "y", "s"])

    return texts.select("key", "text", "prints").mapInArrow(run, "key string, l int, x bigint, y bigint, s bigint")


def contaminated(res: str = "res"):
    """The contract's rule: a twentieth of the words, at least, is hit."""
    return (F.col(f"{res}.n_hit") > 0) & (F.col(f"{res}.n_hit") * 20 >= F.col(f"{res}.n_words"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = decontaminate(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "row.doc_id",
        "res.n_words",
        "res.n_hit",
        F.size("res.item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("res.item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = f"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS l, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
dw AS (
  SELECT doc_id, i, l, array_to_string(ws[i:i + l - 1], ' ') AS s
  FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(ws) >= l)),
m AS (SELECT dw.doc_id, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.s = bw.s),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
  coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
