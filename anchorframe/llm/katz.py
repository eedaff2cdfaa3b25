"""Language-model scoring by a Katz backoff trigram model with Good-Turing discounts.

P(w | u v) is d3(c) * c / c(u v) where the trigram was seen c times in training (d: Good-Turing discount, 1 beyond FEW),
and alpha(u v) * P(w | v) otherwise; P(w | v) is made likewise of bigrams and P(w), and P(w) backs off once more from
discounted word counts to one class of unknown words, which holds the mass the discounts free. A history that training
never saw passes the question on unchanged. alpha is exact: the mass that a history's seen followers leave, over the mass
that the next lower order gives to all others. Sums over the words and the unknown class are 1 for every history.
Everything gathered from the corpus - all counts of all orders - is counted over all training texts.

The tables are too large for one machine, so nothing of them is broadcast. Documents are packed into chunks of about
CHUNK bytes, and chunks talk to partitioned tables:

1. Words: a chunk sends its distinct words with their training counts to partitions by word; totals come back, with
   short ids that are the lower the more frequent a word is. Counts of counts give the discounts d1.
2. Trigrams: a chunk sends every token with its two predecessors (and its document) to the partition of the middle word
   v. There all of c(u v w), c(u v), c(v w), c(v) are summed, and with them both backoff weights, so a partition scores
   its tokens by itself; what comes back is one sum for each document. The partitions read their rows twice: d2 and d3
   come from the counts of counts of the first reading.
3. Chunks add up what they get.

A middle word with more than ``hot`` tokens (at most MOST_HOT of them, whose ids alone are collected) is spread over all
partitions by its follower w. Bigram and trigram counts are still whole there; what belongs to the histories v and u v is
summed over the partitions by one more packed exchange, and the sums go back to the partitions that asked.

A partition holds ``part_tokens`` tokens on average, whatever the size of the corpus, and is worked on by itself; tasks
take several partitions in turn beyond MOST_TASKS. Memory is bounded by the larger of a partition with a word just below the limit, a
chunk and the longest text. Words are 56-bit hashes; sums travel as multiples of 2**-24.

Defined results: null text is empty text, which is one end token; null ids count as id text '' for the split; without
training texts every token is unknown and scores 0; repeated rows are counted as often as they occur; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .common import cut, remainder, tidy
from .exchange import batch, beside, pack, part_of, runs, stream, unpack

CHUNK, FEW = 6 << 20, 5
#: Training tokens of a table partition on average, tasks of a stage at most, and hot words at most.
PART_TOKENS, MOST_TASKS, MOST_HOT = 1_000_000, 20_000, 1_000_000
END = np.uint64(0x873593CC9E2D51)
LOW56 = np.uint64((1 << 56) - 1)
#: Units of a partition's sums for a document.
UNIT = 2.0**24
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Sums of a history: its count, followers seen 1 .. FEW times, and what the lower order gives to its seen followers
#: (for u v as counts of v w above FEW, and how many followers have the bigram count 1 .. FEW; for v as a mass).
SUMS = 2 * FEW + 2


def chunked(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """meta (ids, which are not null, held, tokens), body (words by falling frequency, tokens as numbers of them),
    n (training tokens), d (training documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = tk.column_bytes(b.column(1))
            ids, some = b.column(0).fill_null(0).to_numpy(), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            held = b.column(2).to_numpy(zero_copy_only=False)
            for lo, hi in tk.chunks(offs, size):
                hashes, counts = [], []
                own = offs[lo : hi + 1] - offs[lo]
                part = data[offs[lo] : offs[hi]]
                for s, e in tk.chunks(own):
                    w = tk.words(tk.LOWERED[part[own[s] : own[e]]], own[s : e + 1] - own[s], tk.SPACE)
                    hashes.append(np.insert(w.hashes() & LOW56, w.first[1:], END))
                    counts.append(w.counts() + 1)
                counts = np.concatenate(counts)
                words, at, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
                order = np.argsort(-often, kind="stable")
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order))
                free = counts[~held[lo:hi]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([pack(ids[lo:hi], some[lo:hi], held[lo:hi], counts.astype(np.int64))], pa.binary()), pa.array([pack(words[order], place[at])], pa.binary()),
                        pa.array([int(free.sum())], pa.int64()), pa.array([len(free)], pa.int64()),
                    ],
                    names=["meta", "body", "n", "d"],
                )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (remainder(10) == 0).alias("held"))
    return own.mapInArrow(tidy(run), "meta binary, body binary, n bigint, d bigint")


META = (np.int64, bool, bool, np.int64)


def counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c[c > 0], FEW + 2).astype(np.int64), minlength=FEW + 3)[1 : FEW + 2].astype(float)


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..FEW): Good-Turing discounts from n(1..FEW + 1); absolute discounting where the counts do not allow them."""
    d = np.ones(FEW + 1)
    spare = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    spare = min(max(spare, 0.1), 0.9)
    common = (FEW + 1) * n[FEW] / n[0] if n[0] else 1.0
    for r in range(1, FEW + 1):
        star = (r + 1) * n[r] / n[r - 1] / r if n[r - 1] else 0.0
        x = (star - common) / (1 - common) if common < 1 else 0.0
        d[r] = x if 0.05 < x < 0.99 else (r - spare) / r
    return d


class Unigram:
    """P(w) from a word's training count."""

    def __init__(self, total: int, whole: np.ndarray):
        """``whole``: words seen, words seen 1 .. FEW + 1 times, tokens of words seen 1 .. FEW times and more often."""
        self.total, self.words, self.d = total, whole[0], discounts(whole[1 : FEW + 2])
        mass = whole[FEW + 2 :]
        used = float((mass[:FEW] * self.d[1:]).sum() + mass[FEW]) / max(total, 1)
        self.scale = min(1.0, (1 - 1 / (total + 1)) / used) if used > 0 else 1.0  # something is left for unknown words
        self.unknown = 1 - used * self.scale

    def __call__(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(float)
        return np.where(c > 0, self.scale * np.where(c <= FEW, self.d[np.minimum(c, FEW).astype(np.int64)], 1.0) * c / max(self.total, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.words + 1)))


def freed(few: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts that discounts free, from the numbers of followers seen 1 .. FEW times."""
    return (few * ((1 - d[1:]) * np.arange(1, FEW + 1))).sum(1)


def below(before: np.ndarray, few: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Denominators of histories; where no discount frees anything, one more occurrence stands for the unseen."""
    return np.maximum(before + (freed(few, d) <= 0), 1)


def seen(c: np.ndarray, before: np.ndarray, few: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of followers seen c times, and what their histories leave for all others, from the histories' counts
    and the numbers of followers they saw 1 .. FEW times (both given for each follower)."""
    left, whole = freed(few, d), below(before, few, d)
    return np.where(c <= FEW, d[np.minimum(c, FEW).astype(np.int64)], 1.0) * c / whole, np.where(left <= 0, 1.0, left) / whole


class Part:
    """Tokens of one partition of the trigram table, and the counts that are whole in it."""

    def __init__(self, blobs: list[bytes], hot: np.ndarray):
        ids, often, v, u, w, self.doc, held_out, sizes = [], [], [], [], [], [], [], []
        for b in blobs:
            i, c, dv, du, dw, doc, held = unpack(b, np.int64, np.int64, np.int32, np.int32, np.int32, np.int32, np.uint8)
            ids.append(np.cumsum(i))
            often.append(c)
            v.append(np.cumsum(dv, dtype=np.int64))
            u.append(du)
            w.append(dw)
            self.doc.append(doc)
            held_out.append(np.unpackbits(held)[doc].astype(bool))
            sizes.append(len(doc))
        name, at = np.unique(np.concatenate(ids), return_inverse=True)
        base = np.cumsum([0, *map(len, ids)])
        local = [at[a:b].astype(np.int32) for a, b in zip(base[:-1], base[1:], strict=True)]
        v, u, w = (np.concatenate([m[x] for m, x in zip(local, xs, strict=True)]) for xs in (v, u, w))
        count = np.zeros(len(name), np.int64)
        count[at] = np.concatenate(often)
        train = ~np.concatenate(held_out)
        self.name, self.count, self.sizes = name, count, np.array(sizes)
        k = len(name)
        add = lambda at, n, x=None: np.bincount(at, x, n)
        pair = lambda a, b: np.unique(a.astype(np.int64) * k + b, return_inverse=True)
        # bigrams v w, histories u v, trigrams u v w
        key, of2 = pair(v, w)
        self.v2, self.w2, self.c2 = key // k, key % k, add(of2, len(key), train)
        of2 = of2.astype(np.int32)
        key, ofh = pair(u, v)
        self.uh, self.vh, self.ch = key // k, key % k, add(ofh, len(key), train)
        key, of = pair(ofh.astype(np.int32), w)
        self.h3, self.c3 = key // k, add(of, len(key), train)
        self.b3 = np.zeros(len(key), np.int64)
        self.b3[of] = of2
        self.of = of.astype(np.int32)
        self.cv = add(v, k, train)
        self.is_hot = tk.member(name, hot) >= 0

    def few(self, group: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        """How many members of each group have the count 1 .. FEW (those that are counted at all)."""
        ok = (c >= 1) & (c <= FEW)
        at = group[ok] * FEW + c[ok].astype(np.int64) - 1
        return np.bincount(at, minlength=n * FEW).reshape(n, FEW).astype(float)

    def sums(self, one: Unigram) -> tuple[np.ndarray, np.ndarray]:
        """SUMS of every v and of every u v."""
        k, n = len(self.name), len(self.ch)
        some = self.c2 > 0
        mass = np.bincount(self.v2[some], one(self.count[self.w2[some]]), k)
        of_v = np.concatenate([self.cv[:, None], self.few(self.v2, self.c2, k), mass[:, None], np.zeros((k, FEW))], 1)
        some = self.c3 > 0
        c2 = self.c2[self.b3]
        above = np.bincount(self.h3[some], np.where(c2 > FEW, c2, 0)[some], n)
        lower = np.where(some & (c2 <= FEW), c2, 0)
        of_h = np.concatenate([self.ch[:, None], self.few(self.h3, self.c3, n), above[:, None], self.few(self.h3, lower, n)], 1)
        return of_v, of_h

    def spread(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Histories v and u v of hot words, numbered with all v first, then all u v: the partition in which their sums come
        together, their names, which all partitions agree on, and their numbers; ordered by partition and name."""
        if not self.is_hot.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            v = tk.mix(self.name.astype(np.uint64) * _SPREAD)
            h = tk.mix(v[self.vh] + tk.mix(self.name.astype(np.uint64)[self.uh] + np.uint64(7)))
        at = np.concatenate([np.flatnonzero(self.is_hot), len(v) + np.flatnonzero(self.is_hot[self.vh])])
        key = np.concatenate([v, h])[at]
        to = part_of(key, parts)
        order = np.lexsort((key, to))
        return to[order], key[order], at[order]

    def scores(self, one: Unigram, d2: np.ndarray, d3: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """log10 P of every token; ``whole`` are the SUMS over all partitions of the histories with the numbers ``at``."""
        of_v, of_h = self.sums(one)
        k = len(of_v)
        of_v[at[at < k]], of_h[at[at >= k] - k] = whole[at < k], whole[at >= k]
        before, few, mass = of_v[:, 0], of_v[:, 1 : FEW + 1], of_v[:, FEW + 1]
        p1 = one(self.count[self.w2])
        v, s = self.v2, self.c2.astype(float)
        got, left = seen(s, before[v], few[v], d2)
        p2 = np.where(before[v] > 0, np.where(s > 0, got, left / np.maximum(1 - mass[v], 1e-12) * p1), p1)
        # what P(w | v) gives to the seen followers of u v
        r = np.arange(1, FEW + 1)
        lower = (of_h[:, FEW + 1] + (of_h[:, FEW + 2 :] * (d2[1:] * r)).sum(1)) / below(before, few, d2)[self.vh]
        h, s = self.h3, self.c3.astype(float)
        got, left = seen(s, of_h[h, 0], of_h[h, 1 : FEW + 1], d3)
        p2 = p2[self.b3]
        p3 = np.where(of_h[h, 0] > 0, np.where(s > 0, got, left / np.maximum(1 - lower[h], 1e-12) * p2), p2)
        return np.log10(p3)[self.of]


def score(docs: DataFrame, part_tokens: int = PART_TOKENS, hot_tokens: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row for each document.

    A word is hot above ``hot_tokens`` training tokens: by default two partitions, and one in MOST_HOT of all at least.
    """
    chunks = cut(chunked(docs)).withColumn("cid", F.monotonically_increasing_id())
    total, starts, n_chunks = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("d"), F.lit(0)), F.count("*")).first()
    parts = int(max(8, total // part_tokens))
    limit = max(2 * total // parts, total // MOST_HOT, 1) if hot_tokens is None else hot_tokens
    tasks, chunk_tasks = min(parts, MOST_TASKS), min(max(n_chunks, 1), MOST_TASKS)
    row = pa.schema([("part", pa.int32()), ("cid", pa.int64()), ("blob", pa.binary())])
    answer = pa.schema([*row, ("stat", pa.list_(pa.float64())), ("hot", pa.int64())])

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cid, meta, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held, counts = unpack(meta, *META)[2:]
                words, at = unpack(body, np.uint64, np.int32)
                c = np.bincount(at, np.repeat(~held, counts), len(words)).astype(np.int64)
                part = part_of(words, parts)
                order = np.lexsort((words, part))
                yield batch([(p, cid, pack(np.diff(words[order[s:e]], prepend=np.uint64(0)), c[order[s:e]])) for p, s, e in runs(part[order])], row)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in stream(batches):
            cids, got = zip(*((cid, unpack(blob, np.uint64, np.int64)) for _, cid, blob in rows), strict=True)
            words, at = np.unique(np.concatenate([np.cumsum(w, dtype=np.uint64) for w, _ in got]), return_inverse=True)
            c = np.bincount(at, np.concatenate([x for _, x in got]), len(words)).astype(np.int64)
            place = np.empty(len(words), np.int64)
            place[np.lexsort((words, -c))] = np.arange(len(words))
            base = np.cumsum([0, *(len(w) for w, _ in got)])
            out = [(part, cid, pack(place[at[s:e]], c[at[s:e]]), None, None) for cid, s, e in zip(cids, base[:-1], base[1:], strict=True)]
            mass = np.bincount(np.minimum(c, FEW + 1), c, FEW + 2)[1:]
            out.append((None, None, None, [float((c > 0).sum()), *counts_of_counts(c), *mass], None))
            out += [(None, None, None, None, int(x) * parts + part + 1) for x in place[c > limit]]
            yield batch(out, answer)

    to_part = lambda df, n, key: df.repartition(n, key).sortWithinPartitions(key)
    asked = chunks.select("cid", "meta", "body").mapInArrow(tidy(ask_words), "part int, cid bigint, blob binary")
    words = cut(to_part(asked, tasks, "part").mapInArrow(tidy(count_words), "part int, cid bigint, blob binary, stat array<double>, hot bigint"))
    stats = words.where("stat is not null").select(F.posexplode("stat").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    whole = np.zeros(1 + 2 * (FEW + 1))
    for r in stats.collect():  # as many rows as the array has entries
        whole[r.i] = r.x
    one = Unigram(total, whole)
    # at most total / limit rows, so MOST_HOT; id 0 is the start of a text
    hot = np.sort(np.array([r.hot for r in words.where("hot is not null").select("hot").collect()] + [0] * (starts > limit), np.int64))

    def ask_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cid, rows in stream(batches):
            _, _, body, meta = next(rows)
            _, _, held, counts = unpack(meta, *META)
            names, tokens = unpack(body, np.uint64, np.int32)
            n, docs = len(names), len(counts)
            part = part_of(names, parts)
            order = np.lexsort((names, part))
            ids, often = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
            spans = {p: (s, e) for p, s, e in runs(part[order])}
            for _, p, blob, _ in rows:
                place, c = unpack(blob, np.int64, np.int64)
                at = order[slice(*spans[p])]
                ids[at], often[at] = place * parts + p + 1, c
            doc = np.repeat(np.arange(docs), counts)
            c = often[tokens]
            own = pack(np.bincount(doc, c > 0, docs).astype(np.int64), np.bincount(doc, one.base(c), docs))
            out = [(cid % parts, cid, own, True)]
            rank = np.empty(n + 1, np.int64)  # number of each word in the order of ids; the start of a text is n
            by_id = np.argsort(ids, kind="stable")
            rank[by_id] = np.arange(n + 1)
            ids, often = ids[by_id], often[by_id]
            w, start = rank[tokens], rank[n]
            begin = np.cumsum(counts) - counts
            v, u = np.empty_like(w), np.empty_like(w)
            v[1:], u[2:] = w[:-1], w[:-2]
            v[begin], u[begin] = start, start
            u[begin[counts > 1] + 1] = start
            to = part_of(ids.astype(np.uint64), parts)[v]
            spread = (tk.member(ids, hot) >= 0)[v]
            with np.errstate(over="ignore"):
                to[spread] = part_of(ids[v[spread]].astype(np.uint64) * _SPREAD + tk.mix(ids[w[spread]].astype(np.uint64)), parts)
            order = np.lexsort((u, v, to)) if n >= 1 << 20 or parts >= 1 << 23 else np.argsort((to << 40) | (v << 20) | u, kind="stable")
            w, v, u, doc, to = w[order], v[order], u[order], doc[order].astype(np.int32), to[order]
            bits = np.packbits(held)
            for p, s, e in runs(to):
                used, at = np.unique(np.concatenate([v[s:e], u[s:e], w[s:e]]), return_inverse=True)
                lv, lu, lw = at.astype(np.int32).reshape(3, -1)
                out.append((p, cid, pack(np.diff(ids[used], prepend=0), often[used], np.diff(lv, prepend=np.int32(0)), lu, lw, doc[s:e], bits), False))
            yield batch(out, asks_row)

    asks_row = pa.schema([*row, ("own", pa.bool_())])
    both = chunks.select("cid", F.lit(-1).alias("part"), F.col("body").alias("blob"), "meta").unionByName(words.where("cid is not null").select("cid", "part", "blob", F.lit(None).cast("binary").alias("meta")))
    asks = both.repartition(chunk_tasks, "cid").sortWithinPartitions("cid", "part").mapInArrow(tidy(ask_trigrams), "part int, cid bigint, blob binary, own boolean")
    table = asks.repartition(tasks, "part")

    told = pa.schema([("part", pa.int32()), ("to", pa.int32()), ("blob", pa.binary()), ("x", pa.list_(pa.float64()))])
    as_rows = "part int, to int, blob binary, x array<double>"

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of counts of bigrams and trigrams; sums of hot words' histories, to the partitions where they meet."""
        for part, rows in stream(batches):
            blobs = [blob for _, _, blob, own in rows if not own]
            if not blobs:
                continue
            x = Part(blobs, hot)
            out = [(part, None, None, [*counts_of_counts(x.c2), *counts_of_counts(x.c3)])]
            if x.is_hot.any():
                to, key, at = x.spread(parts)
                sums = np.concatenate(x.sums(one))[at]
                out += [(part, p, pack(np.diff(key[s:e], prepend=np.uint64(0)), *sums[s:e].T), None) for p, s, e in runs(to)]
            yield batch(out, told)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of histories over all partitions, back to each that asked, in its order."""
        for to, rows in stream(batches):
            got = [(part, unpack(blob, np.uint64, *[np.float64] * SUMS)) for _, part, blob in rows]
            with np.errstate(over="ignore"):
                _, at = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for _, g in got]), return_inverse=True)
            whole = [np.bincount(at, np.concatenate([g[1 + i] for _, g in got]))[at] for i in range(SUMS)]
            ends = np.cumsum([len(g[0]) for _, g in got])
            yield batch([(part, to, pack(*(w[e - len(g[0]) : e] for w in whole)), None) for (part, g), e in zip(got, ends, strict=True)], told)

    tallied = table.sortWithinPartitions("part").mapInArrow(tidy(tally), as_rows)
    of_orders = tallied.where("x is not null").agg(*[F.coalesce(F.sum(F.col("x")[i]), F.lit(0.0)).alias(f"n{i}") for i in range(2 * FEW + 2)])
    empty = lambda t: F.lit(None).cast(t)
    asked = table.select("part", F.lit(2).alias("kind"), "cid", "blob", "own", empty("array<double>").alias("x"))
    # to every partition: the counts of counts, and the whole sums of the histories it asks for
    news = of_orders.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), empty("bigint").alias("cid"), empty("binary").alias("blob"), F.array(*of_orders.columns).alias("x"))
    if len(hot):
        sums = to_part(tallied.where("to is not null").select("to", "part", "blob"), tasks, "to").mapInArrow(tidy(add_up), as_rows)
        news = news.unionByName(sums.select("part", F.lit(1).alias("kind"), F.col("to").cast("bigint").alias("cid"), "blob", empty("array<double>").alias("x")))
    news = news.select("part", "kind", "cid", "blob", empty("boolean").alias("own"), "x")
    asked = beside(asked, news, tasks, "part").sortWithinPartitions("part", "kind", "cid")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in stream(batches):
            sums, cids, blobs, out, orders = {}, [], [], [], None
            for _, kind, cid, blob, own, x in rows:
                if kind == 0:
                    orders = x
                elif kind == 1:
                    sums[cid] = blob
                elif own:
                    out.append((0, cid, blob))
                else:
                    cids.append(cid)
                    blobs.append(blob)
            if blobs:
                d2, d3 = discounts(np.array(orders[: FEW + 1])), discounts(np.array(orders[FEW + 1 :]))
                x = Part(blobs, hot)
                to, _, at = x.spread(parts)
                whole = [np.stack(unpack(sums[q], *[np.float64] * SUMS), 1) for q, _, _ in runs(to)]
                p = x.scores(one, d2, d3, at, np.concatenate(whole) if whole else np.zeros((0, SUMS)))
                ends = np.cumsum(x.sizes)
                for cid, s, e, doc in zip(cids, ends - x.sizes, ends, x.doc, strict=True):
                    own = np.bincount(doc, p[s:e])
                    at = np.unique(doc)
                    out.append((1, cid, pack(np.diff(at, prepend=np.int32(0)), np.rint(own[at] * -UNIT).astype(np.int64))))
            if out:
                yield batch(out, pa.schema([("kind", pa.int32()), ("cid", pa.int64()), ("blob", pa.binary())]))

    judged = asked.mapInArrow(tidy(judge), "kind int, cid bigint, blob binary")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in stream(batches):
            _, _, meta = next(rows)
            ids, some, held, counts = unpack(meta, *META)
            known, base, sums = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
            for _, kind, blob in rows:
                if kind == 0:
                    known, base = unpack(blob, np.int64, np.float64)
                else:
                    at, x = unpack(blob, np.int32, np.int64)
                    sums[np.cumsum(at)] -= x / UNIT
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=~some), pa.array(held), pa.array(counts), pa.array(known), pa.array(np.full(len(ids), total, np.int64)), pa.array(base), pa.array(sums)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    every = chunks.select("cid", F.lit(-1).alias("kind"), F.col("meta").alias("blob")).unionByName(judged.select("cid", "kind", "blob"))
    last = every.repartition(chunk_tasks, "cid").sortWithinPartitions("cid", "kind")
    return last.mapInArrow(tidy(finish), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def digest(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"))
