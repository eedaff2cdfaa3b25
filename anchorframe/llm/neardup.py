"""MinHash near-duplicate detection with SetSketch registers.

A document's set is its distinct 5-word shingles. Every set is sketched into registers: the minimum of exponentially
distributed hashes, truncated to exponentially spaced steps, so registers of a union are the larger of two registers
and two sets' registers agree with about the probability of their Jaccard similarity J. Bands of four registers are
joined on; of 40 bands a pair of J = 0.75 shares none with probability 2.5e-7, one of J = 0.3 shares any with 0.28.

1. Equal sets (by 128 bits of sums over their hashes) collapse into one numbered node, so copies cost nothing afterwards.
2. Every node is tied to the smallest node of each of its buckets; the connected components of these ties are candidate
   clusters: two nodes that share any bucket are in one cluster. No pair within a bucket is ever written.
3. A cluster is dealt by hash into blocks of about ``block`` nodes and BLOCK_SHINGLES shingles, whichever gives more
   blocks. Within a block pairs are first judged by the joint likelihood of their registers (given the set sizes; pairs
   whose odds of reaching the threshold are below e**-14 drop out, and without more ado those that agree in less than a
   quarter of the registers, which at J = 0.75 lies 14 standard deviations below the mean) and then verified on the full sets (all at once where many are left). A block only returns which nodes hang together.
4. Clusters of several blocks that are not yet in one piece go on: nodes outside the largest piece meet all nodes of
   their cluster, block against block, so no link between different texts is lost and no task holds more than two
   blocks.
5. Verified links are closed by connected components.

Links are exact (100 * |A & B| >= 75 * |A | B| on 64-bit shingle hashes); only candidate search and the likelihood test
can miss a link, with the probabilities above.

Defined results: null and empty texts (and texts without words) have empty sets and are linked with nothing; a text of
1 to 4 words has its word sequence as one shingle; rows that share a doc_id are one document for linking (component of
the id); rows with a null id are not linked, their component_id is null and they are kept; empty tables give empty
results; extra columns are untouched by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import setsketch as ss, textkit as tk
from .common import LOWER, UPPER, cut, tidy
from .graph import components

NUMERATOR, DENOMINATOR = 75, 100
BLOCK, SURE = 512, 14.0
#: Shingles in a block on average: bounds the bytes of a block where texts are long.
BLOCK_SHINGLES = 2_000_000


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), k1 and k2 (128 bits that name the set), regs (binary); one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w in tk.tokenize(b.column(1)):
                x, _, bounds = ss.shingles(w)
                n = np.diff(bounds)
                regs = ss.registers(x, bounds)
                ends = np.append(x, np.uint64(0))
                with np.errstate(over="ignore"):
                    k1 = np.add.reduceat(ends, bounds[:-1]) * (n > 0) if len(n) else n
                    k2 = np.add.reduceat(tk.mix(ends ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1]) * (n > 0) if len(n) else n
                out.append((n, k1.astype(np.uint64).view(np.int64), k2.astype(np.uint64).view(np.int64), regs))
            cat = lambda i: np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64)
            regs = cat(3).astype(np.uint16).tobytes()
            size = ss.REGISTERS * 2
            regs = pa.array([regs[i * size : i * size + size] for i in range(len(b))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cat(0).astype(np.int64)), pa.array(cat(1)), pa.array(cat(2)), regs], names=["doc_id", "th", "n", "k1", "k2", "regs"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    return own.mapInArrow(tidy(run), "doc_id bigint, th bigint, n bigint, k1 bigint, k2 bigint, regs binary")


def _bands(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), 4096):
                part = b.slice(s, 4096)
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, ss.REGISTERS)
                keys = ss.band_keys(regs).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), ss.BANDS)), pa.array(keys)], names=["v", "key"])

    return nodes.select("v", "regs").mapInArrow(tidy(run), "v bigint, key bigint")


class _Group:
    """Nodes of one group: ids, full sets and registers."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        self.ids = ids
        self.sets: list[np.ndarray] = []
        regs = []
        for w in tk.tokenize(texts):
            x, _, bounds = ss.shingles(w)
            regs.append(ss.registers(x, bounds))
            self.sets += [x[bounds[i] : bounds[i + 1]] for i in range(w.rows)]
        self.regs = np.concatenate(regs) if regs else np.zeros((0, ss.REGISTERS), np.uint16)
        self.n = np.array([len(s) for s in self.sets], np.int64)

    def __len__(self) -> int:
        return len(self.ids)


#: Columns that more pairs than this share are multiplied as dense blocks, the others pair by pair.
HEAVY, STEP = 4096, 1 << 22


def _shared(a: _Group, b: _Group) -> np.ndarray:
    """|A & B| of all pairs of two groups, from the lists of rows that hold each shingle."""
    va, vb = np.concatenate(a.sets), np.concatenate(b.sets)
    ra, rb = np.repeat(np.arange(len(a)), a.n), np.repeat(np.arange(len(b)), b.n)
    cols = np.intersect1d(va, vb)
    sides = []
    for v, r in ((va, ra), (vb, rb)):
        at = tk.member(v, cols)
        at, r = at[at >= 0], r[at >= 0]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], r[order], np.searchsorted(at[order], np.arange(len(cols) + 1))))
    (ca, ra, ea), (cb, rb, eb) = sides
    pairs = np.diff(ea) * np.diff(eb)
    out = np.zeros(len(a) * len(b), np.int64)
    heavy = np.flatnonzero(pairs > HEAVY)
    for lo in range(0, len(heavy), 2048):
        part = heavy[lo : lo + 2048]
        ms = []
        for at, r, n in ((ca, ra, len(a)), (cb, rb, len(b))):
            i = tk.member(at, part)
            m = np.zeros((n, len(part)), np.float32)
            m[r[i >= 0], i[i >= 0]] = 1
            ms.append(m)
        out += np.rint(ms[0] @ ms[1].T).astype(np.int64).ravel()
    light = np.flatnonzero((pairs <= HEAVY) & (pairs > (1 if a is b else 0)))
    done = np.concatenate([[0], np.cumsum(pairs[light])])
    lo = 0
    while lo < len(light):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + STEP, "right")) - 1)
        part = light[lo:hi]
        size, nb = pairs[part], np.diff(eb)[part]
        k = np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        nb, fa, fb = np.repeat(nb, size), np.repeat(ea[part], size), np.repeat(eb[part], size)
        out += np.bincount(ra[fa + k // nb] * len(b) + rb[fb + k % nb], minlength=len(out))
        lo = hi
    return out.reshape(len(a), len(b))


def linked(a: _Group, b: _Group) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of verified links between two groups."""
    small = np.minimum(a.n[:, None], b.n[None, :]) * DENOMINATOR >= NUMERATOR * np.maximum(a.n[:, None], b.n[None, :])
    i, j = np.nonzero(small & (a.ids[:, None] < b.ids[None, :] if a is b else a.ids[:, None] != b.ids[None, :]))
    if not len(i):
        return i, j
    equal, above = (np.empty(len(i), np.int64) for _ in range(2))
    for s in range(0, len(i), 1 << 15):
        x, y = a.regs[i[s : s + (1 << 15)]], b.regs[j[s : s + (1 << 15)]]
        equal[s : s + (1 << 15)], above[s : s + (1 << 15)] = (x == y).sum(1), (x > y).sum(1)
    close = equal * DENOMINATOR >= NUMERATOR * ss.REGISTERS
    doubt = np.flatnonzero(~close & (equal >= ss.REGISTERS // 4))
    if len(doubt):
        for d in np.array_split(doubt, len(doubt) // 32768 + 1):
            ratio, _ = ss.log_ratio(equal[d], above[d], ss.REGISTERS - equal[d] - above[d], a.n[i[d]], b.n[j[d]], NUMERATOR / DENOMINATOR)
            close[d] = ratio <= SURE
    i, j = i[close], j[close]
    if not len(i):
        return i, j
    if len(i) > 2000:
        shared = _shared(a, b)[i, j]
    else:
        shared = np.array([len(np.intersect1d(a.sets[p], b.sets[q], assume_unique=True)) for p, q in zip(i, j, strict=True)], np.int64)
    true = DENOMINATOR * shared >= NUMERATOR * (a.n[i] + b.n[j] - shared)
    return i[true], j[true]


def _spanning(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its piece) for the nodes that are linked at all."""
    root = np.arange(len(ids))
    order = np.argsort(ids)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    root = rank.copy()
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[order[low]]
        if (low == root).all():
            break
        root = low
    own = ids[order[root]]
    moved = own != ids
    return ids[moved], own[moved]


def _stream(keys: list[str], fn: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]):
    """Apply ``fn`` to each run of rows that agree in ``keys`` (rows arrive sorted by them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None

        def flush():
            a, b = fn(pa.concat_tables(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            k = np.stack([t.column(c).to_numpy() for c in keys], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(t)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                key = tuple(k[lo])
                if key != last and held:
                    yield flush()
                    held = []
                last = key
                held.append(t.slice(lo, hi - lo))
        if held:
            yield flush()

    return run


def _group(t: pa.Table, mask: np.ndarray | None = None) -> _Group:
    t = t if mask is None else t.filter(pa.array(mask))
    return _Group(t.column("v").to_numpy(), t.column("text"))


def _inside(t: pa.Table):
    g = _group(t)
    return _spanning(g.ids, *linked(g, g))


def _across(t: pa.Table):
    side = t.column("side").to_numpy()
    a, b = _group(t, side == 0), _group(t, side == 1)
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = linked(a, b)
    ids = np.unique(np.concatenate([a.ids, b.ids]))
    return _spanning(ids, np.searchsorted(ids, a.ids[i]), np.searchsorted(ids, b.ids[j]))


def _links(df: DataFrame, keys: list[str], fn) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(_stream(keys, fn)), "a bigint, b bigint")


def components_of(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each document."""
    spark = docs.sparkSession
    s = cut(sketch(docs))
    full = s.where("n > 0 and doc_id is not null")
    nodes = full.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("n").alias("n"), F.min("regs").alias("regs"))
    nodes = cut(nodes.withColumn("v", F.monotonically_increasing_id()))
    # Rows that share an id, but not a set, are tied through it.
    key = F.struct("k1", "k2")
    twins = full.groupBy("doc_id").agg(F.min(key).alias("b"), F.max(key).alias("z")).where("b <> z").select("doc_id")
    twins = full.join(twins, "doc_id").join(nodes.select("k1", "k2", "v"), ["k1", "k2"]).select("doc_id", "v")
    twins = cut(twins.join(twins.groupBy("doc_id").agg(F.min("v").alias("b")), "doc_id").where("v <> b").select(F.col("v").alias("a"), "b"))
    bands = _bands(nodes)
    hubs = bands.groupBy("key").agg(F.min("v").alias("hub"), F.count("*").alias("m")).where("m > 1").select("key", "hub")
    ties = bands.join(hubs, "key").where("v <> hub").select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = cut(components(ties))
    known = clusters.join(nodes.select("v", "rep", "n"), "v")
    sizes = known.groupBy("c").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = known.join(sizes, "c").select("c", "blocks", "v", F.col("rep.doc_id").alias("i"), F.col("rep.th").alias("h"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    members = members.join(texts, (F.col("i") == F.col("doc_id")) & (F.col("h") == F.col("th"))).dropDuplicates(["v"])
    deal = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    members = cut(members.select("c", "blocks", "v", "text", deal.alias("blk")))
    found = cut(_links(members, ["c", "blk"], _inside))
    wide = members.where("blocks > 1").select("c", "blocks", "v", "blk")
    if not wide.isEmpty():
        pieces = wide.join(components(found).withColumnRenamed("c", "piece"), "v", "left").withColumn("piece", F.coalesce("piece", "v"))
        counts = pieces.groupBy("c", "piece").agg(F.count("*").alias("m"))
        largest = counts.groupBy("c").agg(F.max(F.struct("m", "piece")).alias("x"), F.count("*").alias("pieces")).where("pieces > 1").select("c", F.col("x.piece").alias("main"))
        open_ = pieces.join(largest, "c")
        outer = open_.where("piece <> main").select("v", "c", F.lit(True).alias("outer"))
        many = outer.groupBy("c").agg(F.ceil(F.count("*") / block).cast("int").alias("oblocks"))
        both = members.join(many, "c").join(outer.drop("c"), "v", "left")
        oblk = F.pmod(F.xxhash64("v", F.lit(1)), F.col("oblocks")).cast("int")
        left = both.where("outer").select("c", oblk.alias("ob"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mb"), "v", "text", F.lit(0).alias("side"))
        right = both.select("c", F.explode(F.sequence(F.lit(0), F.col("oblocks") - 1)).alias("ob"), F.col("blk").alias("mb"), "v", "text", F.lit(1).alias("side"))
        found = cut(found.unionByName(_links(left.unionByName(right), ["c", "ob", "mb"], _across)))
    links = components(found.unionByName(twins))
    joined = nodes.select("k1", "k2", "v", F.col("rep.doc_id").alias("least")).join(links, "v", "left")
    loose = joined.where("c is null").select("k1", "k2", F.col("least").alias("component_id"))
    tied = joined.where("c is not null")
    smallest = tied.groupBy("c").agg(F.min("least").alias("component_id"))
    labels = loose.unionByName(tied.join(smallest, "c").select("k1", "k2", "component_id"))
    out = s.select("doc_id", "n", "k1", "k2").join(labels, ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns; rows without an id stay."""
    gone = components_of(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.v = d.doc_id
"""
