"""Collocations by pivot partitioning.

A phrase's pivot is its rarest word (its leftmost occurrence, where it has several). All phrases of one pivot are counted in
one place, and only what they are made of is sent there:

1. Chunks of texts ask partitions for the frequencies of their distinct words and pairs of neighbours, each once with its
   number, so that every chunk knows which words and pairs reach ``least`` occurrences (no other can be in a
   candidate) and which of two words is rarer.
2. Every occurrence of a word that has neighbours no rarer than itself sends a rewritten fragment: itself with up to
   two such words on either side, of one piece of text and as far as the pairs are frequent. A fragment goes to the pivot's partition; equal fragments of a chunk
   go once with their number. Hot pivots have few distinct fragments, since few words are as frequent, and those above
   ``hot`` occurrences are dealt by chunk and summed up once more.
3. A partition mines its fragments: the phrases of two or three words around the pivot, and no others, so every occurrence
   of a phrase is counted once and its total is final there.
4. Candidates meet the counts of their parts by joins, those inside a longer one with most of their occurrences go, and
   each language's first ones are taken among the first ones of its shares.

Frequencies of step 1 go by hashes (64 bits for words, 48 for pairs) and only decide on routing and on what can be left out (a collision could only
keep more); all counts that are returned are of the words themselves.

Defined results: null texts are empty, a null lang is ``und``; words never span rows or pieces; repeated rows count again;
empty tables and languages without candidates give no rows; extra columns are ignored; ids are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import textkit as tk
from .common import LOWER, UPPER, cut, table, tidy
from .exchange import batch, beside, pack, part_of, stream, unpack
from .substrings import chunked

LEAST, FIRST, LONGER = 10, 2000, 50
#: Bytes of text in a chunk, chunks for each partition of words and pairs, tasks of a stage at most.
CHUNK, PART_CHUNKS, MOST_TASKS = 6 << 20, 2, 20_000
#: Occurrences of a pivot above which its fragments are dealt by chunk, and shares of a language that are ranked apart.
HOT, SHARES = 1 << 22, 64
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATE = BREAK.copy()
SEPARATE[[0x20, 0x09]] = True


class Unit:
    """Words of some rows of a chunk: ids of distinct (lang, word), their keys and texts, and the pieces."""

    def __init__(self, w: tk.Words, langs: np.ndarray, lang_key: np.ndarray):
        lang = langs[w.lo : w.hi][w.row]
        self.key, first, self.id = np.unique(tk.join(lang_key[lang], w.hashes()), return_index=True, return_inverse=True)
        self.lang, self.often = lang[first], np.bincount(self.id, minlength=len(first))
        self.text = pa.array([w.text(i) for i in first.tolist()], pa.binary())
        piece = np.cumsum(BREAK[w.data])[w.start] if len(w) else w.start
        self.joined = np.append((piece[1:] == piece[:-1]) & (w.row[1:] == w.row[:-1]), False)  # to the next word

    def pairs(self) -> np.ndarray:
        """48 bits of each pair of neighbours within a piece, in order."""
        return tk.join(self.key[self.id[:-1]], self.key[self.id[1:]])[self.joined[:-1]] >> np.uint64(16)


def _coded(*columns: np.ndarray) -> np.ndarray:
    """One number for each tuple, in their order; what is too long for 63 bits is numbered anew on the way."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        top = int(c.max(initial=0)) + 1
        if (int(code.max(initial=0)) + 1) * top >= 1 << 63:
            code = np.unique(code, return_inverse=True)[1]
        code = code * top + c
    return code


class _Table:
    """Distinct keys and their numbers, dealt to partitions."""

    def __init__(self, key: np.ndarray, often: np.ndarray, parts: int):
        part = part_of(key, parts)
        self.order = np.argsort(part, kind="stable")
        self.part, self.key, self.often = part[self.order], key[self.order], often[self.order].astype(np.int64)

    def span(self, p: int) -> slice:
        return slice(*np.searchsorted(self.part, [p, p + 1]))

    def of(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.key[self.span(p)], prepend=np.uint64(0)), self.often[self.span(p)]


class Chunk:
    """A chunk's texts, by language."""

    def __init__(self, body: bytes, parts: int):
        rows = pa.ipc.open_stream(body).read_all().combine_chunks().column(0).chunk(0)
        coded = pc.dictionary_encode(rows.field("lang"))
        langs, self.names = coded.indices.to_numpy(), coded.dictionary
        w = next(tk.tokenize(self.names, np.zeros(256, bool), lower=False, size=1 << 40), None)
        keys = np.zeros(len(self.names), np.uint64)
        if w is not None:
            keys[w.row] = w.hashes()
        self.units = [Unit(w, langs, keys) for w in tk.tokenize(rows.field("text"), SEPARATE, size=CHUNK)]
        key = np.concatenate([u.key for u in self.units] or [np.zeros(0, np.uint64)])
        often = np.concatenate([u.often for u in self.units] or [np.zeros(0, np.int64)])
        self.key, at = np.unique(key, return_inverse=True)
        self.often = np.bincount(at, often, len(self.key)).astype(np.int64)
        self.pair, pair_often = np.unique(np.concatenate([u.pairs() for u in self.units] or [np.zeros(0, np.uint64)]), return_counts=True)
        self.tables = [_Table(self.key, self.often, parts), _Table(self.pair, pair_often, parts)]

    def asks(self) -> list[tuple[int, bytes]]:
        return [(p, pack(*[x for t in self.tables for x in t.of(p)])) for p in np.unique(np.concatenate([t.part for t in self.tables])).tolist()]

    def frequencies(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Totals of the words, and whether each pair is frequent."""
        out = [np.zeros(len(self.key), np.int64), np.zeros(len(self.pair), np.uint8)]
        for p, blob in answers.items():
            for t, into, got in zip(self.tables, out, unpack(blob, np.int64, np.uint8), strict=True):
                into[t.order[t.span(p)]] = got
        return out[0], out[1].astype(bool)

    def fragments(self, total: np.ndarray, frequent: np.ndarray, least: int, hot: int, cid: int) -> Iterator[pa.RecordBatch]:
        """Fragments with their pivots' keys, places and numbers; single words and the languages' sums (no word) too."""
        rank = np.empty(len(self.key), np.int64)
        rank[np.lexsort((self.key, total))] = np.arange(len(self.key))
        for u in self.units:
            at = np.searchsorted(self.key, u.key)
            joined = u.joined.copy()
            joined[u.joined] = frequent[np.searchsorted(self.pair, u.pairs())]
            f, own = total[at], np.where(total[at] >= least, rank[at], -1)
            r, n = own[u.id], len(u.id)
            pad = np.pad(r, 2, constant_values=-1)
            joined = np.pad(joined, 2)  # joined[i + 2]: word i to word i + 1
            i = np.flatnonzero(r >= 0)
            l1 = joined[i + 1] & (pad[i + 1] > r[i])
            l2 = l1 & joined[i] & (pad[i] > r[i])
            r1 = joined[i + 2] & (pad[i + 3] >= r[i])
            r2 = r1 & joined[i + 3] & (pad[i + 4] >= r[i])
            some = l1 | r1
            i, sides = i[some], [x[some] for x in (l2, l1, r1, r2)]
            ids = np.pad(u.id, 2)
            near = [np.where(ok, ids[i + 2 + step] + 1, 0) for ok, step in zip(sides, (-2, -1, 1, 2), strict=True)]
            _, rep, often = np.unique(_coded(u.id[i], *near), return_index=True, return_counts=True)  # a pivot's side by side
            pivot = u.id[i[rep]]
            columns = [u.text.take(pa.array(x[rep] - 1, mask=x[rep] == 0)) for x in near[:2]] + [u.text.take(pa.array(pivot))] + [u.text.take(pa.array(x[rep] - 1, mask=x[rep] == 0)) for x in near[2:]]
            frag = pc.binary_join_element_wise(*columns, b" ", null_handling="skip")
            place = (sides[0].astype(np.int8) + sides[1])[rep]
            alone = np.flatnonzero(f >= least)
            sums = np.bincount(u.lang, u.often, len(self.names)).astype(np.int64)
            held = np.flatnonzero(sums)
            salts = np.concatenate([-(-f[pivot] // hot), -(-f[alone] // hot), np.ones(len(held), np.int64)])
            lang = self.names.take(pa.array(np.concatenate([u.lang[pivot], u.lang[alone], held])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([u.key[pivot], u.key[alone], np.zeros(len(held), np.uint64)]).view(np.int64)),
                    pa.array(np.where(salts > 1, cid % salts + 1, 0).astype(np.int32)),
                    lang,
                    pa.concat_arrays([frag, u.text.take(pa.array(alone)), pa.array([b""] * len(held), pa.binary())]).cast(pa.string()),
                    pa.array(np.concatenate([place, np.zeros(len(alone) + len(held), np.int8)])),
                    pa.array(np.concatenate([often, u.often[alone], sums[held]])),
                ],
                names=["key", "salt", "lang", "frag", "place", "n"],
            )


def _count(least: int):
    """Answers each chunk's question with its words' totals over all chunks and whether its pairs reach ``least``."""
    schema = pa.schema([("part", pa.int32()), ("cid", pa.int64()), ("blob", pa.binary())])

    def total(got: list, i: int) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            names, at = np.unique(np.concatenate([np.cumsum(g[i], dtype=np.uint64) for g in got]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([g[i + 1] for g in got]), len(names)).astype(np.int64)[at]
        return np.split(sums, np.cumsum([len(g[i]) for g in got])[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in stream(batches):
            cids, got = zip(*((cid, unpack(blob, np.uint64, np.int64, np.uint64, np.int64)) for _, cid, blob in rows), strict=True)
            yield batch([(part, cid, pack(w, (p >= least).astype(np.uint8))) for cid, w, p in zip(cids, total(got, 0), total(got, 2), strict=True)], schema)

    return run


def counts(docs: DataFrame, least: int = LEAST, size: int = CHUNK, hot: int = HOT) -> DataFrame:
    """lang, phrase, a: all phrases of one to three words with ``least`` occurrences, and each lang's words (empty phrase)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = cut(chunked(rows, "text", size))
    count = chunks.count()
    parts = max(16, count // PART_CHUNKS)
    n, tasks = min(max(count, 1), MOST_TASKS), min(max(16, count), MOST_TASKS)
    placed = chunks.select("cid", F.lit(-1).alias("part"), F.col("body").alias("blob")).repartition(n, "cid")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("cid", pa.int64()), ("blob", pa.binary())])
        for b in batches:
            for cid, body in zip(*(x.to_pylist() for x in b.columns), strict=True):
                yield batch([(p, cid, blob) for p, blob in Chunk(body, parts).asks()], schema)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cid, rows in stream(batches):
            _, part, body = next(rows)
            if part != -1:
                raise RuntimeError("answers without their chunk")
            c = Chunk(body, parts)
            yield from c.fragments(*c.frequencies({p: blob for _, p, blob in rows}), least, hot, cid & 0xFFFFFFFF)

    asked = chunks.mapInArrow(tidy(ask), "part int, cid bigint, blob binary")
    answers = asked.repartition(min(parts, MOST_TASKS), "part").sortWithinPartitions("part").mapInArrow(tidy(_count(least)), "part int, cid bigint, blob binary")
    told = beside(placed, answers.select("cid", "part", "blob"), n, "cid").sortWithinPartitions("cid", "part")
    sent = told.mapInArrow(tidy(send), "key bigint, salt int, lang string, frag string, place tinyint, n bigint")
    at_pivot = sent.repartition(tasks, "key", "salt").withColumn("w", F.split("frag", " "))
    mined = at_pivot.select("key", "salt", "lang", "n", F.explode(_owned()).alias("phrase"))
    total = mined.groupBy("key", "salt", "lang", "phrase").agg(F.sum("n").alias("a"))
    enough = F.col("a") >= F.when(F.col("phrase") == "", 1).otherwise(least)
    # one branch: filters on the share alone are pushed below the exchange, and chunks rewritten for each of them
    return total.where((F.col("salt") > 0) | enough).groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(enough)


def _owned():
    """The phrases of two or three words around the pivot of a fragment; a single word (or none) stands for itself."""
    made = []
    for k in (2, 3):
        for back in reversed(range(k)):
            ok = (F.col("place") >= back) & (F.col("place") - back + k <= F.size("w"))
            made.append(F.when(ok, F.array_join(F.slice("w", F.col("place") - back + 1, k), " ")))
    return F.when(F.size("w") == 1, F.array("frag")).otherwise(F.array_compact(F.array(*made)))


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, longer: int = LONGER, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's ``first`` phrases."""
    grams = cut(counts(docs, least, **options).withColumn("w", F.split("phrase", " ")).withColumn("k", F.when(F.col("phrase") == "", 0).otherwise(F.size("w"))))
    join = lambda lo, hi: F.array_join(F.slice("w", lo, hi), " ")
    long = grams.where("k = 3").select("lang", "phrase", "a", join(1, 2).alias("head"), join(2, 2).alias("tail"))
    part = grams.where("k in (1, 2)").select(F.col("lang").alias("p_lang"), F.col("phrase").alias("p"), F.col("a").alias("f"))

    def with_f(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(part, (F.col("lang") == F.col("p_lang")) & (F.col(column) == F.col("p"))).drop("p_lang", "p").withColumnRenamed("f", name)

    cuts = grams.where("k in (2, 3)").select("lang", "phrase", "a", "k", *[x.alias(c) for c, x in {"p1": join(1, 1), "p2": F.when(F.col("k") == 2, join(2, 1)).otherwise(join(2, 2)), "q1": F.when(F.col("k") == 2, join(1, 1)).otherwise(join(1, 2)), "q2": F.element_at("w", -1)}.items()])
    for c in ("p1", "p2", "q1", "q2"):
        cuts = with_f(cuts, c, f"f_{c}")
    inside = long.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    stay = cuts.join(inside, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * longer))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    stay = stay.withColumn("top", F.lit(1000000).cast("decimal(7,0)") * (wide("a") * wide("a")).cast("decimal(31,0)"))
    for c in "pq":
        stay = stay.withColumn(f"below_{c}", wide(f"f_{c}1") * wide(f"f_{c}2")).withColumn(f"score_{c}", F.expr(f"top div below_{c}"))
    use_p = (F.col("k") == 2) | (F.col("score_p") <= F.col("score_q"))
    pick = lambda p, q: F.when(use_p, F.col(p)).otherwise(F.col(q))
    scored = stay.select("lang", "phrase", "a", pick("f_p1", "f_q1").alias("l"), pick("f_p2", "f_q2").alias("r"), pick("score_p", "score_q").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("_r") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= first)
    n = grams.where("k = 0").select("lang", F.col("a").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def digest(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS MATERIALIZED (SELECT lang, ws FROM (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p) WHERE len(ws) > 0),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS MATERIALIZED (
  SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS a FROM (
    SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) x(k) WHERE len(ws) >= k))
  GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (
  SELECT lang, phrase, k, a, c, array_to_string(ws[1:c], ' ') AS x, array_to_string(ws[c + 1:], ' ') AS y, ws
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS c FROM g WHERE k > 1)),
s AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.c, x.a AS l, y.a AS r,
    CAST((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM c JOIN g x ON x.lang = c.lang AND x.phrase = c.x JOIN g y ON y.lang = c.lang AND y.phrase = c.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
t AS (
  SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE k = 3))
  GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
FROM b JOIN n USING (lang) LEFT JOIN t ON t.lang = b.lang AND t.phrase = b.phrase
WHERE t.longest IS NULL OR 100 * t.longest < {LONGER} * b.a
QUALIFY rank <= {FIRST}
"""
