"""Line deduplication by content-defined line chunks (DataFrame operations only).

A text is split at line feeds and every line has a hash; a rolling hash runs over ``WINDOW`` consecutive line hashes. A
line whose rolling hash is 0 modulo ``divisor`` proposes to end a chunk. A proposal counts unless the line before makes
one too, or a piece of one line would be left at the text's edge, so every chunk of a longer text has two lines or more.
All this depends on three lines at most: a passage that is moved, or stands between other lines, is cut alike everywhere
but at its edges.

1. Chunks that occur more than once anywhere are removed, save the first occurrence in the order of (doc_id, text hash,
   line number).
2. A repeated passage also has lines before its first boundary and after its last one. They are found by the keys of
   overlapping pairs of lines: of all pairs that do not lie in a removed chunk, a pair that stands at an earlier place
   too is removed. The first place of a pair never lies in a removed chunk, so the two steps together remove exactly the
   lines that lie in a run of two lines or more (not all white space) with an earlier occurrence.
3. Both steps work on a skeleton of the texts, 20 bytes a line. Texts are then fetched for the lines that are to go and
   for their first occurrences: a line goes only if all lines of its 128-bit key have the same bytes.

Counts and first occurrences are mergeable aggregates. Keys that hold more than a ``HOT``-th of all rows (so fewer than
``HOT`` keys) are joined by broadcast, so no key's rows meet in one task.

Defined results: a null text has no lines and stays null; an empty text is one empty line; a text whose lines all go
becomes empty; repeated rows (equal doc_id and text) count as repeats of their lines for other documents but are
treated alike, so neither removes the other's; null ids order first; empty tables give empty results; extra columns
stay as they are, in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

WINDOW, DIVISOR, HOT = 2, 3, 1000
#: Up to so many repeated keys (60 bytes each) are broadcast to the pieces; beyond, both are shuffled.
BROADCAST_KEYS = 250_000
_FACTOR = 31
#: Lines are joined in runs of at least two.
PAIR = 2


def _let(value, body):
    return F.transform(F.array(value), body)[0]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_number(line: Column) -> Column:
    """28 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("bigint")


def _at(array: Column, i: Column) -> Column:
    """Entry ``i`` (from 1) of ``array``, 0 before the first."""
    return F.when(i > 0, F.element_at(array, F.greatest(i, F.lit(1)))).otherwise(F.lit(0))


def chunk_ends(numbers: Column, divisor: int = DIVISOR) -> Column:
    """array<int>: numbers (from 1) of the lines that end a chunk, from the line numbers."""
    n = F.size(numbers)
    proposes = lambda i: ((_at(numbers, i - 1) * _FACTOR + _at(numbers, i)) % divisor == 0) & (i > 0)
    return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | ((i > 1) & (i < n - 1) & proposes(i) & ~proposes(i - 1)))


def _skeleton(docs: DataFrame, text_col: str, divisor: int) -> DataFrame:
    """d, h, keys (128 bits of each line), full (is it more than white space), ends; one row per text."""
    own = docs.where(F.col(text_col).isNotNull()).select(F.col("doc_id").alias("d"), F.xxhash64(text_col).alias("h"), _lines(F.col(text_col)).alias("l"))
    hashed = own.select("d", "h", F.transform("l", lambda x: F.unhex(F.md5(x.cast("binary")))).alias("keys"), F.transform("l", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full"), F.transform("l", line_number).alias("a"))
    return hashed.select("d", "h", "keys", "full", chunk_ends(F.col("a"), divisor).alias("ends"))


def _key(keys: Column) -> Column:
    return F.unhex(F.md5(F.aggregate(keys, F.lit(b""), lambda acc, k: F.concat(acc, k))))


def _later(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables (d, h, s, n): the rows of ``pieces`` (key, d, h, s, n) that have an earlier place, and the first places
    of all keys that repeat."""
    seen = pieces.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("d", "h", "s")).alias("first"), F.max("n").alias("n"))
    rows, seen = pieces.count(), cut(seen.where("m > 1"))
    if seen.count() <= BROADCAST_KEYS:
        joined = pieces.drop("n").join(F.broadcast(seen), "key")
    else:
        hot = F.broadcast(seen.where(F.col("m") * HOT > rows))  # fewer than HOT rows
        rest = pieces.drop("n").join(hot.select("key"), "key", "left_anti")
        joined = pieces.drop("n").join(hot, "key").unionByName(rest.join(seen.where(F.col("m") * HOT <= rows), "key"))
    return joined.where(~F.struct("d", "h", "s").eqNullSafe(F.col("first"))).select("d", "h", "s", "n"), seen.select("first.*", "n")


def _same(a: str, b: str) -> Column:
    return F.col("d").eqNullSafe(F.col(a)) & F.col("h").eqNullSafe(F.col(b))


def _covered(spans: Column) -> Column:
    """Line numbers (from 0) of spans (s, n)."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1))))


def _spans(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("d", "h").agg(F.collect_set(F.struct("s", "n")).alias(name)).select(F.col("d").alias(f"{name}_d"), F.col("h").alias(f"{name}_h"), name)


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, text_col: str = "text") -> DataFrame:
    """Columns ``row`` (all of ``docs``) and ``res``: text (what is left), n_lines, n_chunks, n_removed (lines), removed
    (their numbers from 0, in no order)."""
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    text = F.col(f"row.`{text_col}`")
    own = own.select("row", F.col("row.doc_id").alias("d"), F.xxhash64(text).alias("h"))
    bones = cut(_skeleton(docs, text_col, divisor))

    several = bones.where(F.size("keys") >= PAIR)
    chunk = F.explode(F.transform("ends", lambda e, j: _let(_at(F.col("ends"), j).cast("int"), lambda b: F.struct(b.alias("s"), (e - b).alias("n")))))
    chunks = several.select("d", "h", "keys", "full", chunk.alias("x")).select("d", "h", "x.s", "x.n", "keys", "full")
    part = lambda c: F.slice(c, F.col("s") + 1, F.col("n"))
    chunks = chunks.where(F.exists(part("full"), lambda f: f)).select(_key(part("keys")).alias("key"), "d", "h", "s", "n")
    copied, first_chunks = _later(chunks)
    copied = cut(copied.distinct())

    marked = several.join(_spans(copied, "cut"), _same("cut_d", "cut_h"), "left")
    inside = F.flatten(F.transform("cut", lambda x: F.sequence(x["s"], x["s"] + x["n"] - PAIR)))
    starts = F.sequence(F.lit(0), F.size("keys") - PAIR)
    starts = F.when(F.col("cut").isNull(), starts).otherwise(F.array_except(starts, inside))
    pairs = marked.select("d", "h", "keys", "full", F.explode(starts).alias("s"))
    line = lambda c, k: F.element_at(c, F.col("s") + k)
    pairs = pairs.where(line("full", 1) | line("full", 2)).select(F.unhex(F.md5(F.concat(line("keys", 1), line("keys", 2)))).alias("key"), "d", "h", "s", F.lit(PAIR).alias("n"))
    again, first_pairs = _later(pairs)
    gone = cut(copied.unionByName(again.distinct()).groupBy("d", "h").agg(F.collect_list(F.struct("s", "n")).alias("spans")).select("d", "h", _covered(F.col("spans")).alias("gone")))

    # byte comparison: all lines that are to go, and the first places of their pairs and chunks
    firsts = first_chunks.unionByName(first_pairs).groupBy("d", "h").agg(F.collect_set(F.struct("s", "n")).alias("spans")).select("d", "h", _covered(F.col("spans")).alias("at"))
    places = gone.select("d", "h", F.col("gone").alias("at")).unionByName(firsts)
    places = places.groupBy("d", "h").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")).select(F.col("d").alias("pd"), F.col("h").alias("ph"), "at")
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    fetched = texts.join(places, _same("pd", "ph")).select(F.explode(_let(_lines(F.col("t")), lambda l: F.transform("at", lambda i: F.element_at(l, i + 1)))).alias("line"))
    texts_of = fetched.groupBy("line").count().groupBy(F.unhex(F.md5(F.col("line").cast("binary"))).alias("key")).agg(F.count("*").alias("m"))
    differ = cut(texts_of.where("m > 1").select("key"))
    if not differ.isEmpty():
        doubt = gone.join(bones.select(F.col("d").alias("bd"), F.col("h").alias("bh"), "keys").dropDuplicates(["bd", "bh"]), _same("bd", "bh"))
        doubt = doubt.select("d", "h", F.explode("gone").alias("i"), "keys").select("d", "h", "i", F.element_at("keys", F.col("i") + 1).alias("key"))
        gone = doubt.join(differ, "key", "left_anti").groupBy("d", "h").agg(F.collect_set("i").alias("gone"))

    facts = bones.select("d", "h", F.size("keys").alias("n"), F.size("ends").alias("c")).distinct()
    facts = facts.join(gone.select(F.col("d").alias("gd"), F.col("h").alias("gh"), "gone"), _same("gd", "gh"), "left").select(F.col("d").alias("fd"), F.col("h").alias("fh"), "n", "c", "gone")
    long = lambda c: c.cast("bigint")
    kept = _let(_lines(text), lambda l: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("gone")), lambda i: F.element_at(l, i + 1)), "\n"))
    res = F.struct(
        F.when(F.col("gone").isNull(), text).otherwise(kept).alias("text"),
        long(F.coalesce("n", F.lit(0))).alias("n_lines"),
        long(F.coalesce("c", F.lit(0))).alias("n_chunks"),
        long(F.coalesce(F.size("gone"), F.lit(0))).alias("n_removed"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("removed"),
    )
    return own.join(facts, _same("fd", "fh"), "left").select("row", res.alias("res"))


def digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("row.doc_id", "res.n_lines", "res.n_chunks", "res.n_removed", "res.text")


ORACLE = f"""
WITH l AS (
  SELECT doc_id, i, n, line, CAST('0x' || left(md5(line), 7) AS BIGINT) AS a
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i,
          len(string_split(text, chr(10))) AS n
        FROM documents WHERE text IS NOT NULL)),
r AS (
  SELECT *, (coalesce(lag(a) OVER w, 0) * {_FACTOR} + a) % {DIVISOR} = 0 AS proposes
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, i = n OR (i > 1 AND i < n - 1 AND proposes AND NOT lag(proposes) OVER w) AS ends FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after, i < n AS paired FROM l),
q AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) AS k FROM p
    WHERE paired AND (regexp_matches(line, '[^\\x20\\x09-\\x0D]') OR regexp_matches(after, '[^\\x20\\x09-\\x0D]'))) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM q),
f AS (SELECT e.doc_id, e.i, e.line, e.ends, g.i IS NOT NULL AS gone FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.i = e.i)
SELECT d.doc_id, CAST(count(f.i) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE f.ends) AS BIGINT) AS n_chunks,
  CAST(count(*) FILTER (WHERE f.gone) AS BIGINT) AS n_removed,
  CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(f.line, chr(10) ORDER BY f.i) FILTER (WHERE NOT f.gone), '') END AS text
FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""
