"""Substring deduplication by recompression.

Every word sequence is parsed bottom-up into symbols. A round first merges runs of equal symbols, then pairs: each name
has a pseudo-random bit, and neighbours with the bits 0 and 1 become one symbol. Names are 64-bit hashes of the words a
symbol spans, so naming is global (equal spans have equal names in every document and on every machine) without an
exchange of dictionaries. Whether a boundary survives a round depends on its two neighbours only, so every boundary
carries the hull of words that decided its fate so far: inside equal substrings, boundaries whose hull lies inside are
the same.

A window of ``window`` words takes as its anchor the boundary of the highest round whose hull lies within the window;
among several, the one whose hull has the least name, which neighbouring windows mostly share. The anchor is a function of
the window's words alone, so equal windows have equal anchors at equal offsets; a window without any has its own hash as
its key. What goes through Spark are the symbols that anchors stand for, and not windows:

1. Naming: chunks of documents send the name of every anchor's hull with its context (all words of all windows of the
   anchor) to partitions by name, each distinct pair once with its number. A name that the corpus holds once is
   unrepeated, and most are. A name with one context only proves all its windows repeated.
2. Verification: only where a shared name has different contexts, single windows are sent, by two hashes of their words.
3. What repeated windows cover is cut out of the documents.

A chunk sends equal names once, so copies of a text or a passage that a third of all documents share add one entry for
each chunk. Chunks are dealt to partitions once and stay there; only the packed names travel. Equality is decided on 128
bits, two hashes of the words with different seeds (of name and context, or of a window), and not on the words.

Defined results: null and empty texts have no words and keep the empty string; texts shorter than a window lose nothing;
repeated rows are occurrences of their own and so repeat each other; null ids are kept; empty tables give empty results;
extra columns are carried in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from . import textkit as tk
from .common import cut, struct_array
from .exchange import batch, beside, distinct, pack, part_of, runs, stream, unpack

WINDOW, ROUNDS = 35, 5
#: Bytes of text in a chunk, chunks for each table partition, and tasks of a stage at most.
CHUNK, PART_CHUNKS, MOST_TASKS = 6 << 20, 4, 20_000
_FAR = 1 << 40


def _merge(keep: np.ndarray, low: np.ndarray, new_low: np.ndarray, at: np.ndarray, reduce) -> np.ndarray:
    """Hull bound of what lies inside each symbol after removing the boundaries that are not kept."""
    return reduce(np.where(keep, low, np.minimum(low, new_low) if reduce is np.minimum.reduceat else np.maximum(low, new_low)), at)


def rounds(h: np.ndarray, first: np.ndarray, s: tk.Spans, count: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(boundary, hull from, hull to) that survive each round; ``first`` are the rows' first words, ``s`` the spans of h."""
    m = len(h)
    pos = np.arange(m)
    fixed = np.zeros(m, bool)
    fixed[first[first < m]] = True
    low, high = pos.copy(), pos.copy()
    end = m  # before anything is merged, that a word starts (or a text ends) somewhere depends on nothing else
    in_low, in_high = np.full(m, _FAR), np.full(m, -_FAR)
    for t in range(count):
        for pairs in (False, True):
            if len(pos) < 2:
                return
            name = tk.span_hash(h, pos, np.append(pos[1:], m), s)
            if pairs:
                bit = (tk.mix(name ^ np.uint64(0xD6E8FEB86659FD93 + t)) & np.uint64(1)).astype(bool)
                drop = ~bit[:-1] & bit[1:]
            else:
                drop = name[:-1] == name[1:]
            drop = np.append(False, drop) & ~fixed
            nl, nh = low.copy(), high.copy()
            nl[1:] = np.minimum(np.minimum(low[:-1], in_low[:-1]), np.minimum(low[1:], in_low[1:]))
            nl[1:-1] = np.minimum(nl[1:-1], low[2:])
            nh[1:] = np.maximum(np.maximum(high[:-1], in_high[:-1]), np.maximum(high[1:], in_high[1:]))
            nh[1:-1] = np.maximum(nh[1:-1], high[2:])
            nh[-1] = max(nh[-1], end)
            nl[fixed], nh[fixed], end = -_FAR, _FAR, _FAR  # a text's first boundary stays, unlike an equal one within
            keep = ~drop
            at = np.flatnonzero(keep)
            in_low = _merge(keep, in_low, nl, at, np.minimum.reduceat)
            in_high = _merge(keep, in_high, nh, at, np.maximum.reduceat)
            pos, low, high, fixed = pos[at], nl[at], nh[at], fixed[at]
        yield pos, low, high


def anchors(w: tk.Words, p: tk.Spans, q: tk.Spans, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Runs of windows of one anchor: row, key, ctx, s1, s2 (first windows' first words within the chunk).

    ``p`` and ``q`` are the spans of the words' hashes in both lanes: names and keys are of the first, contexts of the second.
    """
    m = len(w)
    empty = np.zeros(0, np.int64)
    n = m - window + 1
    if n <= 0:
        return {"row": empty, "key": empty.astype(np.uint64), "ctx": empty.astype(np.uint64), "s1": empty, "s2": empty}
    valid = w.row[:n] == w.row[window - 1 :]
    anchor, level = np.full(n, -1), np.zeros(n, np.int64)
    a_low, a_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    h, begin = p.levels[0], w.first[w.row]
    for t, (pos, low, high) in reversed(list(enumerate(rounds(h, w.first[:-1], p), 1))):
        ok = (low >= 0) & (high <= m) & (high - low <= window)
        pos, low, high = pos[ok], low[ok], high[ok]
        lo, hi = np.maximum(high - window, begin[pos]), np.minimum(low, w.first[w.row[pos] + 1] - window)
        open_ = np.concatenate([[0], np.cumsum(valid & (anchor < 0))])
        use = hi >= lo
        use[use] = open_[hi[use] + 1] > open_[lo[use]]
        pos, low, high, lo, hi = pos[use], low[use], high[use], lo[use], hi[use]
        if not len(pos):
            continue
        rank = np.argsort(tk.mix(tk.span_hash(h, low, np.maximum(high, low), p) + (pos - low).astype(np.uint64)), kind="stable")
        pos, low, high, lo, hi = pos[rank], low[rank], high[rank], lo[rank], hi[rank]
        reps = hi - lo + 1
        which = np.repeat(np.arange(len(pos)), reps)
        s = np.repeat(lo - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
        best = np.full(n, -1)
        best[s[::-1]] = which[::-1]  # the least name wins
        new = np.flatnonzero(valid & (anchor < 0) & (best >= 0))
        b = best[new]
        anchor[new], level[new], a_low[new], a_high[new] = pos[b], t, low[b], high[b]
    s = np.flatnonzero(valid)
    none = anchor[s] < 0
    anchor[s[none]], a_low[s[none]], a_high[s[none]] = s[none], s[none], s[none] + window
    start = np.ones(len(s), bool)
    start[1:] = (anchor[s[1:]] != anchor[s[:-1]]) | (level[s[1:]] != level[s[:-1]]) | (np.diff(s) != 1)
    s1, s2 = s[start], s[np.append(np.flatnonzero(start)[1:] - 1, len(s) - 1)] if len(s) else s
    b, t = anchor[s1], level[s1]
    with np.errstate(over="ignore"):
        key = tk.mix(tk.span_hash(h, a_low[s1], a_high[s1], p) + (b - a_low[s1]).astype(np.uint64) * np.uint64(1000003) + t.astype(np.uint64))
        ctx = tk.mix(q.of(s1, s2 + window) ^ ((b - s1 + 64) * 4096 + (s2 - s1)).astype(np.uint64))
    return {"row": w.row[s1], "key": key, "ctx": ctx, "s1": s1, "s2": s2}


def chunked(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """cid and body: rows of about ``size`` bytes of text as one compressed Arrow stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid = TaskContext.get().partitionId() << 32
        for b in batches:
            rows = b.column(0)
            _, offs = tk.column_bytes(rows.field(text_col))
            for lo, hi in tk.chunks(offs, size):
                sink = pa.BufferOutputStream()
                part = pa.RecordBatch.from_arrays([rows.slice(lo, hi - lo)], names=["row"])
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([cid]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["cid", "body"])
                cid += 1

    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).mapInArrow(run, "cid bigint, body binary")


class Chunk:
    """Rows of a chunk and the anchors of their texts."""

    def __init__(self, body: bytes, text_col: str, window: int, parts: int):
        table = pa.ipc.open_stream(body).read_all().combine_chunks()
        self.rows = table.column(0).chunk(0)
        self.texts, self.window, self.parts, self.pieces = self.rows.field(text_col), window, parts, []
        for w in tk.tokenize(self.texts, lower=False):
            p, q = (tk.Spans(w.hashes(lane)) for lane in (0, 1))
            self.pieces.append((w, (p.levels[0], q.levels[0]), anchors(w, p, q, window)))
        cat = lambda k: np.concatenate([a[k] for _, _, a in self.pieces]) if self.pieces else np.zeros(0, np.int64)
        key, ctx = cat("key").astype(np.uint64), cat("ctx").astype(np.uint64)
        self.part, self.key, self.ctx, self.often, self.at = distinct(part_of(key, parts), key, ctx)

    def __len__(self) -> int:
        return len(self.rows)

    def names(self) -> list[tuple[int, bytes]]:
        return [(p, pack(np.diff(self.key[s:e], prepend=np.uint64(0)), self.ctx[s:e], self.often[s:e])) for p, s, e in runs(self.part)]

    def judged(self, flags: dict[int, np.ndarray], part: np.ndarray) -> np.ndarray:
        return np.concatenate([flags[p] for p, _, _ in runs(part)]) if len(part) else np.zeros(0, np.uint8)

    def open_windows(self, state: np.ndarray) -> None:
        """The windows of anchors with state 2: rows, first words (within the row) and their distinct hashes."""
        rows, firsts, one, two, done = [], [], [], [], 0
        for w, h, a in self.pieces:
            mine = state[done : done + len(a["row"])] == 2
            done += len(a["row"])
            s1, s2 = a["s1"][mine], a["s2"][mine]
            reps = s2 - s1 + 1
            s = (np.repeat(s1 - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())).astype(np.int64) if len(s1) else np.zeros(0, np.int64)
            row = np.repeat(a["row"][mine], reps)
            for into, x in zip((one, two), h, strict=True):
                into.append(tk.span_hash(x, s, s + self.window))
            rows.append(row + w.lo)
            firsts.append(s - w.first[row])
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.w_row, self.w_first = cat(rows, np.int64), cat(firsts, np.int64)
        h1, h2 = cat(one, np.uint64), cat(two, np.uint64)
        self.w_part, self.h1, self.h2, self.w_often, self.w_at = distinct(part_of(h1, self.parts), h1, h2)

    def windows(self) -> list[tuple[int, bytes]]:
        return [(p, pack(np.diff(self.h1[s:e], prepend=np.uint64(0)), self.h2[s:e], self.w_often[s:e])) for p, s, e in runs(self.w_part)]

    def spans(self, state: np.ndarray, again: np.ndarray) -> list[np.ndarray]:
        """Per row the [from, to) of its words that repeated windows cover."""
        row, lo, hi, done = [self.w_row[again]], [self.w_first[again]], [self.w_first[again] + self.window], 0
        for w, _, a in self.pieces:
            sure = state[done : done + len(a["row"])] == 1
            done += len(a["row"])
            r = a["row"][sure]
            row.append(r + w.lo)
            lo.append(a["s1"][sure] - w.first[r])
            hi.append(a["s2"][sure] - w.first[r] + self.window)
        row, lo, hi = (np.concatenate(x).astype(np.int64) for x in (row, lo, hi))
        order = np.lexsort((lo, row))
        row, lo, hi = row[order], lo[order], hi[order]
        cuts = np.searchsorted(row, np.arange(len(self) + 1))
        out = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                out.append(np.zeros((0, 2), np.int64))
                continue
            reach = np.maximum.accumulate(hi[s:e])
            new = np.append(True, lo[s + 1 : e] > reach[:-1])
            out.append(np.stack([lo[s:e][new], reach[np.append(np.flatnonzero(new)[1:] - 1, e - s - 1)]], 1))
        return out


def _told(batches: Iterator[pa.RecordBatch], text_col: str, window: int, parts: int) -> Iterator[tuple[int, Chunk, np.ndarray, list]]:
    """Every chunk (kind -1) with the states of its anchors (kind 0) and the rows of later answers."""
    for cid, rows in stream(batches):
        _, kind, _, body = next(rows)
        if kind != -1:
            raise RuntimeError("answers without their chunk")
        c, flags, more = Chunk(body, text_col, window, parts), {}, []
        for _, kind, part, blob in rows:
            if kind == 0:
                flags[part] = unpack(blob, np.uint8)[0]
            else:
                more.append((part, blob))
        yield cid, c, c.judged(flags, c.part)[c.at], more


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("text", T.StringType())])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """Columns ``row`` (all of ``docs``) and ``res``: n_words, n_removed, spans of removed words [from, to), text (kept
    words, joined by one space)."""
    chunks = cut(chunked(docs, text_col, size))
    count = chunks.count()
    parts = max(16, count // PART_CHUNKS)
    n, tasks = min(max(count, 1), MOST_TASKS), min(parts, MOST_TASKS)
    placed = chunks.select("cid", F.lit(-1).alias("kind"), F.lit(-1).alias("part"), F.col("body").alias("blob")).repartition(n, "cid")
    ask = pa.schema([("part", pa.int32()), ("cid", pa.int64()), ("blob", pa.binary())])
    asked = "part int, cid bigint, blob binary"

    def ask_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cid, body in zip(*(x.to_pylist() for x in b.columns), strict=True):
                yield batch([(p, cid, blob) for p, blob in Chunk(body, text_col, window, parts).names()], ask)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """0 for a name that occurs once, 1 for one with one context, 2 for one with several."""
        for part, rows in stream(batches):
            cids, got = zip(*((cid, unpack(blob, np.uint64, np.uint64, np.int64)) for _, cid, blob in rows), strict=True)
            with np.errstate(over="ignore"):
                key = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _, _ in got])
            ctx, often = (np.concatenate([g[i] for g in got]) for i in (1, 2))
            _, at = np.unique(key, return_inverse=True)
            low, high = np.full(at.max() + 1, np.iinfo(np.uint64).max), np.zeros(at.max() + 1, np.uint64)
            np.minimum.at(low, at, ctx)
            np.maximum.at(high, at, ctx)
            state = np.where(np.bincount(at, often) > 1, np.where(low == high, 1, 2), 0).astype(np.uint8)[at]
            ends = np.cumsum([len(g[0]) for g in got])
            yield batch([(part, cid, pack(state[e - len(g[0]) : e])) for cid, g, e in zip(cids, got, ends, strict=True)], ask)

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cid, c, state, _ in _told(batches, text_col, window, parts):
            c.open_windows(state)
            yield batch([(p, cid, blob) for p, blob in c.windows()], ask)

    def count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in stream(batches):
            cids, got = zip(*((cid, unpack(blob, np.uint64, np.uint64, np.int64)) for _, cid, blob in rows), strict=True)
            with np.errstate(over="ignore"):
                h1 = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _, _ in got])
            h2, often = (np.concatenate([g[i] for g in got]) for i in (1, 2))
            at = distinct(np.zeros(len(h1), np.int8), h1, h2)[4]
            again = (np.bincount(at, often) > 1).astype(np.uint8)[at]
            ends = np.cumsum([len(g[0]) for g in got])
            yield batch([(part, cid, pack(again[e - len(g[0]) : e])) for cid, g, e in zip(cids, got, ends, strict=True)], ask)

    def answers(asks: DataFrame, fn) -> DataFrame:
        return asks.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(fn, asked)

    def to_chunks(*tables: DataFrame) -> DataFrame:
        more = None
        for kind, t in enumerate(tables):
            t = t.select("cid", F.lit(kind).alias("kind"), "part", "blob")
            more = t if more is None else more.unionByName(t)
        return beside(placed, more, n, "cid").sortWithinPartitions("cid", "kind", "part")

    states = cut(answers(chunks.mapInArrow(ask_names, asked), judge))
    repeats = answers(to_chunks(states).mapInArrow(ask_windows, asked), count_windows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c, state, more in _told(batches, text_col, window, parts):
            c.open_windows(state)
            again = c.judged({p: unpack(blob, np.uint8)[0] for p, blob in more}, c.w_part)[c.w_at].astype(bool)
            words, removed, spans, kept = [], [], [], []
            for text, own in zip(c.texts.to_pylist(), c.spans(state, again), strict=True):
                ws = (text or "").encode().split()
                words.append(len(ws))
                if len(own):
                    edges = [0, *own.ravel().tolist(), len(ws)]
                    ws = [x for a, b in zip(edges[::2], edges[1::2], strict=True) for x in ws[a:b]]
                removed.append(words[-1] - len(ws))
                spans.append(own.tolist())
                kept.append(b" ".join(ws).decode())
            res = struct_array({"n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "text": pa.array(kept, pa.string())})
            yield pa.RecordBatch.from_arrays([c.rows, res], names=["row", "res"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("res", RESULT)])
    return to_chunks(states, repeats).mapInArrow(finish, schema)


def digest(docs: DataFrame) -> DataFrame:
    out = dedup_substrings(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "res.n_words", "res.n_removed", F.sha2("res.text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
x AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM w WHERE len(ws) >= {WINDOW})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS m FROM x) WHERE m > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM r),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (
  SELECT t.doc_id, count(p.i) AS gone, string_agg(t.word, ' ' ORDER BY t.i) FILTER (WHERE p.i IS NULL) AS kept
  FROM t LEFT JOIN p ON p.doc_id = t.doc_id AND p.i = t.i GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
