"""Mixing sources to target weights by pivotal dependent rounding (DataFrame operations only).

A source with target t and size S takes each of its words r = t / S times on average. Every document gets floor(r)
copies, and one more with probability p = r - floor(r). The extra copies are not drawn independently: two fractional
documents are paired and word mass is moved from one to the other, in a random direction with odds that keep both
expectations, until one of them is integral. The sum of mass * p never changes, so a source's taken words miss its
target by less than one document, whatever the number of documents.

Pairing runs down a distributed reduction tree. The documents of a source are dealt by hash into blocks of about
``block`` documents; a block folds its documents one after another and passes on at most one fractional document; these
residuals are dealt into blocks again until a source has one block left, its root. In a pair the smaller document is
settled first, so residuals are large documents. The root therefore also gets a reserve (about ``block`` / 2 documents
of the source that stay out of the tree) and settles its items largest first, each against all that are left as one
pooled partner, whose probabilities shift together; what stays unbalanced in the end is about the smallest item. A
source with a third of all rows only has more blocks. All coins are hashes of ids and sizes: reruns agree whatever the
partitioning.

Targets: sources ordered by code point, null last, have the weights 5, 2, 1, repeating, and share ``share`` times all
words; a target stops at ``cap`` times its source's size and the excess is shared again by weight among the rest until
none is above. Each round of that is one aggregate over the table of sources. Sources are numbered range by range, so a
table of many sources (one per web host, say) meets in no task either.

Defined results: null and empty texts have size 0 and take 0; a source of size 0 has target 0; rows that agree in
doc_id, source and size share one decision (their joint mass is what is paired); null ids and null sources are values
like others; an empty table gives an empty result; extra columns are untouched by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, cut, unit

SHARE, CAP, WEIGHTS, BLOCK, SEED = 1.5, 2.0, (5, 2, 1), 128, 17
#: Sources up to this number (a few MB) are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def size_of(text_col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``nth``, the place of its source (from 0) by code point, null last."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    upto = F.sum("count").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))  # a row per range, n at most
    frame = dealt.groupBy("range").count().select("range", F.coalesce(upto, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("place", place).join(F.broadcast(frame), "range").select(*sources.columns, (F.col("before") + F.col("place")).alias("nth"))


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from (source, size)."""
    s = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int")))
    s = cut(s.select("source", "source_size", "w", (F.col("source_size") * F.lit(cap)).alias("top")))
    total, weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    level, known = (total * share / weight if weight else 0.0), None
    while level != known:  # the level only rises, and each round stops at least one more source
        known = level
        stops = F.col("w") * F.lit(level) > F.col("top")
        full, rest = s.agg(F.coalesce(F.sum(F.when(stops, F.col("top"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~stops, F.col("w"))), F.lit(0.0))).first()
        level = max(level, (total * share - full) / rest) if rest else level
    return s.select("source", "source_size", F.least(F.col("w") * F.lit(level), F.col("top")).alias("target"))


def _fold(level: int, seed: int):
    """Fold a block's ordered ``items``: what became integral (``done``) and the one that may stay fractional (``cur``)."""
    item = "struct<doc_id:bigint,source:string,size:bigint,mass:double,p:double>"
    out = "array<struct<doc_id:bigint,source:string,size:bigint,up:boolean>>"
    start = F.struct(F.lit(None).cast(item).alias("cur"), F.array().cast(out).alias("done"))

    def fix(x, up):
        return F.struct(x["doc_id"].alias("doc_id"), x["source"].alias("source"), x["size"].alias("size"), up.alias("up"))

    def with_p(x, p):
        return F.struct(x["doc_id"].alias("doc_id"), x["source"].alias("source"), x["size"].alias("size"), x["mass"].alias("mass"), p.alias("p"))

    def pair(a, b):
        """(result struct) of one transfer between a and b."""
        up, down = F.least(a["mass"] * (1 - a["p"]), b["mass"] * b["p"]), F.least(a["mass"] * a["p"], b["mass"] * (1 - b["p"]))
        coin = unit(a["doc_id"], a["size"], b["doc_id"], b["size"], seed=seed * 64 + level)
        move = F.when(coin * (up + down) < down, up).otherwise(-down)
        tiny = F.lit(1e-9)
        moved = F.transform(F.array(move), lambda d: F.struct((a["p"] + d / a["mass"]).alias("pa"), (b["p"] - d / b["mass"]).alias("pb")))

        def settle(m):
            a_in, b_in = (m["pa"] < tiny) | (m["pa"] > 1 - tiny), (m["pb"] < tiny) | (m["pb"] > 1 - tiny)
            a_out, b_out = fix(a, m["pa"] > 0.5), fix(b, m["pb"] > 0.5)
            return (
                F.when(a_in & b_in, F.struct(F.lit(None).cast(item).alias("cur"), F.array(a_out, b_out).alias("done")))
                .when(a_in, F.struct(with_p(b, m["pb"]).alias("cur"), F.array(a_out).alias("done")))
                .otherwise(F.struct(with_p(a, m["pa"]).alias("cur"), F.array(b_out).alias("done")))
            )

        return F.transform(moved, settle)[0]

    def step(acc, x):
        paired = F.transform(F.array(pair(acc["cur"], x)), lambda r: F.struct(r["cur"].alias("cur"), F.concat(acc["done"], r["done"]).alias("done")))[0]
        return F.when(acc["cur"].isNull(), F.struct(x.alias("cur"), acc["done"].alias("done"))).otherwise(paired)

    items = F.transform(F.array_sort("items"), lambda x: F.struct(*[x[c].alias(c) for c in ("doc_id", "source", "size", "mass", "p")]))
    return F.aggregate(items, start, step)


def _root(seed: int):
    """Settle all ``items`` of a root, largest first, each against the rest as one pooled partner.

    Every item left has probability a * p + b: moving mass between an item and the pool changes a and b only.
    """
    out = "array<struct<doc_id:bigint,source:string,size:bigint,up:boolean>>"
    total = lambda f: F.aggregate("items", F.lit(0.0), lambda acc, x: acc + f(x))
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), total(lambda x: x["mass"]).alias("m"), total(lambda x: x["mass"] * x["p"]).alias("q"), F.array().cast(out).alias("done"))

    def let(value, body):
        return F.transform(F.array(value), body)[0]

    def step(acc, x):
        m, q, p = acc["m"] - x["mass"], acc["q"] - x["mass"] * x["p"], acc["a"] * x["p"] + acc["b"]
        taken = acc["a"] * q + acc["b"] * m
        state = F.struct(m.alias("m"), q.alias("q"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), F.greatest(F.lit(0.0), taken).alias("in"), F.greatest(F.lit(0.0), m - taken).alias("out"))

        def choose(v):
            rise, fall = v["in"] >= x["mass"] * (1 - v["p"]), v["out"] >= x["mass"] * v["p"]
            coin = unit(x["doc_id"], x["size"], seed=seed * 64 + 63)
            up = F.when(rise & fall, coin < v["p"]).when(rise, F.lit(True)).when(fall, F.lit(False)).otherwise(v["p"] >= 0.5)
            return let(up, lambda u: move(v, u))

        def move(v, u):
            safe = lambda need, pool: F.when(pool > 0, F.least(F.lit(1.0), need / pool)).otherwise(F.lit(0.0))
            shift = F.when(u, safe(x["mass"] * (1 - v["p"]), v["in"])).otherwise(safe(x["mass"] * v["p"], v["out"]))
            return let(
                shift,
                lambda t: F.struct(
                    (acc["a"] * (1 - t)).alias("a"),
                    (acc["b"] * (1 - t) + F.when(u, F.lit(0.0)).otherwise(t)).alias("b"),
                    v["m"].alias("m"),
                    v["q"].alias("q"),
                    F.concat(acc["done"], F.array(F.struct(x["doc_id"].alias("doc_id"), x["source"].alias("source"), x["size"].alias("size"), u.alias("up")))).alias("done"),
                ),
            )

        return let(state, choose)

    items = F.transform(F.array_sort("items"), lambda x: F.struct(*[x[c].alias(c) for c in ("doc_id", "source", "size", "mass", "p")]))
    return F.aggregate(items, start, step, lambda acc: acc["done"])


def decide(sizes: DataFrame, target: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row for each distinct (doc_id, source, size)."""
    few = target.count() <= BROADCAST_SOURCES
    t = F.broadcast(target) if few else target
    t = t.select(F.col("source").alias("_s"), "source_size", "target")
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    keys = (
        sizes.groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("m"))
        .join(t, F.col("source").eqNullSafe(F.col("_s")), "left")
        .drop("_s")
        .withColumn("base", F.floor(r))
        .withColumn("p", r - F.floor(r))
    )
    frac = keys.where((F.col("p") > 0) & (F.col("size") > 0)).select("doc_id", "source", "size", (F.col("size") * F.col("m")).cast("double").alias("mass"), "p")
    counts = frac.groupBy("source").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    counts = (F.broadcast(counts) if few else counts).select(F.col("source").alias("_s"), "n", F.ceil(F.col("n") / block).alias("nb"))
    order = F.struct((-F.col("mass")).alias("o"), F.xxhash64(F.lit(seed), "doc_id", "size").alias("h"), "doc_id", "source", "size", "mass", "p")
    here = frac.join(counts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    root = (F.col("nb") <= 1) | (unit("doc_id", "size", seed=seed * 64 + 62) * F.col("n") < block / 2)
    roots, here, done, level = here.where(root), here.where(~root).drop("n"), [], 0
    while most > block:
        deal = F.pmod(F.xxhash64(F.lit(seed + 1000 * (level + 1)), "doc_id", "size"), F.col("nb"))
        blocks = here.groupBy("source", "nb", deal.alias("blk")).agg(F.collect_list(order).alias("items"))
        got = cut(blocks.select("source", "nb", _fold(level, seed).alias("r")))
        done.append(got.select(F.explode("r.done").alias("x")).select("x.*"))
        here = got.where("r.cur is not null").select("r.cur.*", F.ceil(F.col("nb") / block).alias("nb"))
        roots = roots.select("doc_id", "source", "size", "mass", "p").unionByName(here.where("nb <= 1").drop("nb"))
        here = here.where("nb > 1")
        most, level = -(-most // block), level + 1
    every = roots.groupBy("source").agg(F.collect_list(order).alias("items")).select(F.explode(_root(seed)).alias("x")).select("x.*")
    for d in done:
        every = every.unionByName(d)
    every = every.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size")], "up")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "source", "size")]
    joined = keys.join(every, same, "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.when(F.col("up"), 1).otherwise(0)).cast("bigint").alias("copies"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row for each document."""
    sizes = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size")))
    got = decide(sizes, cut(targets(sizes))).select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size")], "source_size", "target", "copies")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "source", "size")]
    return sizes.join(got, same, "left").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The documents the mix takes at all, with all their columns and ``copies``, the times each is taken.

    A column of the input that is named ``copies`` is replaced; other names never clash, since rows travel as structs.
    """
    own = docs.drop("copies")
    rows = own.select(
        F.struct(*[own[f"`{c}`"] for c in own.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size")
    )
    sizes = cut(rows.select("doc_id", "source", "size"))
    got = decide(sizes, cut(targets(sizes))).where("copies > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), "copies")
    same = [F.col("doc_id").eqNullSafe(F.col("_d")), F.col("source").eqNullSafe(F.col("_s")), F.col("size") == F.col("_n")]
    return rows.join(got, same).select("row.*", "copies")
