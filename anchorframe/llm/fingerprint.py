"""Document fingerprints by a homomorphic multiset hash (DataFrame operations only).

Every paragraph (line) is hashed to a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors
modulo 2**60 per lane. The sum does not depend on the order of paragraphs, and a paragraph is inserted into or deleted
from a fingerprint by adding or subtracting its vector: no other part of the text is needed. The vector has

* ``EQUAL`` lanes of 60 bits, drawn by seeded hashes from the paragraph's SHA-512: equal texts (as multisets of paragraphs)
  have equal lanes, others differ with overwhelming probability;
* one lane that counts the paragraph's pieces (sentences; very long ones are cut after words that end in certain
  letters), and
* ``NEAR`` lanes, each two counters of 30 bits, of the one bits of the pieces' hashes. A text of 2 GB, the longest there
  can be, has fewer pieces than that, so no counter carries into the next. A counter of n pieces gives 2 * ones - n, a sum
  of random signs; over 120 counters the sums of two texts give an estimate of how many pieces they share, with no access
  to the texts (:func:`likeness`, standard error about 0.1).

The query gets an edited text's fingerprint from the text's own: the paragraphs from the cut on are deleted
(:func:`subtract`) and those of the new end inserted (:func:`combine`).

Defined results: null is the empty text; empty texts have the fingerprint of one empty paragraph; repeated rows have
equal results; rows that share a doc_id are ordered by text, null ids come first; the next document of the last is the
first, so a single row is its own next; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

EQUAL, HASHES, SHIFTS, COUNTER = 16, 2, 30, 30
NEAR = HASHES * SHIFTS
MASK = (1 << 60) - 1
#: Bits 0 and 30.
SPREAD = 1 | 1 << COUNTER
LONG_PIECE = 300
#: Documents in a bucket of the ordered pass, on average, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS, COARSE = 2000, 4096, 64


def _let(value, body):
    return F.transform(F.array(value), body)[0]


def _wrap(x):
    return x.bitwiseAND(F.lit(MASK))


def pieces(text: Column) -> Column:
    """Sentences of all paragraphs; pieces never span a line feed."""
    sentences = F.split(text, r"\n|(?<=[.!?])[\x20\x09]+", -1)
    return F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) > LONG_PIECE, F.split(s, r"(?<=[dgkmstz|])[\x20\x09]+", -1)).otherwise(F.array(s))))


def vector(text: Column) -> Column:
    """Fingerprint of ``text`` (not null) as array<bigint>: EQUAL lanes, the count, NEAR lanes."""

    def add_line(acc, line):
        return _let(F.sha2(line, 512), lambda d: F.transform(acc, lambda a, i: _wrap(a + _wrap(F.xxhash64(i, d)))))

    def add_piece(acc, p):
        hashes = F.array(*[F.xxhash64(F.lit(j), p) for j in range(HASHES)])
        return _let(
            hashes,
            lambda h: F.transform(acc, lambda a, i: _wrap(a + F.call_function("shiftrightunsigned", F.element_at(h, (i / SHIFTS).cast("int") + 1), i % SHIFTS).bitwiseAND(F.lit(SPREAD)))),
        )

    equal = F.aggregate(F.split(text, "\n", -1), F.array_repeat(F.lit(0).cast("bigint"), EQUAL), add_line)
    near = _let(pieces(text), lambda p: F.concat(F.array(F.size(p).cast("bigint")), F.aggregate(p, F.array_repeat(F.lit(0).cast("bigint"), NEAR), add_piece)))
    return F.concat(equal, near)


def combine(a: Column, b: Column) -> Column:
    """Fingerprint of two texts' paragraphs together; inserts a paragraph's vector."""
    return F.zip_with(a, b, lambda x, y: _wrap(x + y))


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint without the paragraphs of b; deletes a paragraph's vector."""
    return F.zip_with(a, b, lambda x, y: _wrap(x - y))


def to_string(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the shared pieces over all pieces, estimated from two fingerprints; 1 for equal ones."""
    na, nb = F.element_at(a, EQUAL + 1), F.element_at(b, EQUAL + 1)
    pairs = F.zip_with(F.slice(a, EQUAL + 2, NEAR), F.slice(b, EQUAL + 2, NEAR), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def count(v, k):
        return F.shiftrightunsigned(v, k * COUNTER).bitwiseAND(F.lit((1 << COUNTER) - 1)).cast("double") * 2

    def add(acc, p):
        ab, sq = acc["ab"], acc["sq"]
        for k in range(60 // COUNTER):
            x, y = count(p["x"], k) - na, count(p["y"], k) - nb
            ab, sq = ab + x * y, sq + x * x + y * y
        return F.struct(ab.alias("ab"), sq.alias("sq"))

    zero = F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("sq"))
    ratio = F.aggregate(pairs, zero, add, lambda acc: F.when(acc["sq"] > 0, 2 * acc["ab"] / acc["sq"]).otherwise(F.lit(0.0)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` and, in ``next``, the struct of ``columns`` of the next row by (doc_id, text), cyclically.

    Documents are dealt to buckets of consecutive ids, whose bounds are ids themselves (approximate quantiles of the id
    column, at most MAX_BUCKETS numbers on the driver); each is sorted on its own, and a bucket's first document is
    also sent to the bucket before, so texts are shuffled once.
    """
    n, some = docs.agg(F.count("*"), F.count("doc_id")).first()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    quantiles = docs.select("doc_id").agg(F.percentile_approx("doc_id", [i / buckets for i in range(buckets)], 100 * buckets)).first()[0] if some else []
    least = docs.agg(F.min("doc_id")).first()[0] if some else None
    bounds = sorted({*(quantiles or []), *([] if least is None else [least])})
    last = max(0, len(bounds) - 1)
    # Two short searches instead of one over all bounds.
    coarse = F.array(*[F.lit(x).cast("bigint") for x in bounds[::COARSE]]) if bounds else F.array().cast("array<bigint>")
    fine = F.array(*[F.lit(x).cast("bigint") for x in bounds]) if bounds else F.array().cast("array<bigint>")
    upto = lambda a: F.size(F.filter(a, lambda x: x <= F.col("doc_id")))
    at = _let(F.greatest(upto(coarse), F.lit(1)) - 1, lambda c: c * COARSE + F.greatest(upto(F.slice(fine, c * COARSE + 1, COARSE)), F.lit(1)) - 1) if bounds else F.lit(0)
    own = docs.withColumn("_b", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at).cast("int"))
    is_first = F.col("doc_id").isNull() if some < n else F.col("doc_id") == F.lit(least)
    leads = F.array_contains(fine, F.col("doc_id")) & (F.col("_b") > 0)
    none = F.array().cast("array<struct<b:int,g:int>>")
    place = lambda b, g: F.array(F.struct(b.cast("int").alias("b"), F.lit(g).alias("g")))
    spots = F.concat(place(F.col("_b"), 0), F.when(leads, place(F.col("_b") - 1, 1)).otherwise(none), F.when(is_first, place(F.lit(last), 2)).otherwise(none))
    dealt = own.withColumn("_s", F.explode(spots)).select("*", F.col("_s.b").alias("_p"), F.col("_s.g").alias("_g")).drop("_b", "_s")
    order = W.partitionBy("_p").orderBy("_g", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).where("_g = 0").drop("_p", "_g")


def digest(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = own.select("doc_id", "text", vector(F.col("text")).alias("v"))
    ordered = with_next(marked, ["text", "v"])
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    own = ordered.select("doc_id", "text", "v", F.col("next.v").alias("w"), F.substring("text", F.lit(1), size - half).alias("head"), F.substring(F.col("next.text"), F.lit(1), half).alias("end"))
    # the paragraph that the cut falls into, and all after it, before and after the edit
    last = F.substring_index("head", "\n", -1)
    old, new = F.concat(last, F.substring("text", F.length("head") + 1, size)), F.concat(last, "end")
    both = own.select(
        "doc_id", size.cast("bigint").alias("n_chars"), F.sha2(F.concat("head", "end"), 256).alias("edited_sha256"), "v", "w", combine(subtract(F.col("v"), vector(old)), vector(new)).alias("e")
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        to_string(F.col("v")).alias("fingerprint"),
        to_string(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("e")).alias("near_edited"),
        likeness(F.col("v"), F.col("w")).alias("near_next"),
    )

