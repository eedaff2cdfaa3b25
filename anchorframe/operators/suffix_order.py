"""Unique matches between sequences of any length: suffixes ranked by prefix doubling, one Spark round for each doubling.

A text is a sequence on one strand, given in pieces. A suffix's class is first that of its WORD letters; a round joins every
suffix with the class of the one ``h`` letters on and so tells apart what agrees in ``h`` letters, but not in ``2 h``. Suffixes
that are alone in their class are settled and only looked up from then on, so a round costs what is still open, and
there are as many rounds as the longest repeat has doublings. The classes of each round are kept: two suffixes share
``WORD << t`` letters if they are of one open class of round t, which gives neighbours' common prefixes from the longest
stride down. A text's end is unlike everything, so no match runs over it.

No task holds a text or a class: classes are counted before they are numbered, running sums go block by block, and
the windows over neighbouring suffixes run within blocks of ranks, each with the first rows of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scalar
from ..functions.ordered import WIDTH, Scratch, ranked, running_sum, shared, with_next

WORD = 8
TEXT = ["grp", "seq_idx", "fwd"]
#: Suffixes of a block of ranks.
BLOCK = 1 << 20


def texts(pieces: DataFrame, both_strands: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pieces of all texts (grp, seq_idx, fwd, at, seq) and the texts' lengths (grp, seq_idx, n), from pieces of sequences
    (grp, seq_idx, at, seq), which lie end to end; empty ones may be missing."""
    own = pieces.where("seq <> ''").select("grp", F.col("seq_idx").cast("int").alias("seq_idx"), F.col("at").cast("bigint").alias("at"), "seq")
    sizes = scratch.keep(own.groupBy("grp", "seq_idx").agg(F.sum(F.length("seq")).alias("n")))
    out = own.withColumn("fwd", F.lit(True))
    if both_strands:
        turned = own.join(sizes, ["grp", "seq_idx"]).withColumn("at", F.col("n") - F.col("at") - F.length("seq")).withColumn("seq", scalar.reverse_complement(F.col("seq")))
        out = out.unionByName(turned.drop("n").withColumn("fwd", F.lit(False)))
    return out.select(*TEXT, "at", "seq"), sizes


def suffixes(pieces: DataFrame, word: int = WORD) -> DataFrame:
    """grp, seq_idx, fwd, place, word (its first letters), before (the letter before it, as a number; less than 0 at a
    text's start, and unlike in all texts of a group)."""
    ends = pieces.select(*TEXT, "at", F.substring("seq", 1, word - 1).alias("head"), F.substring("seq", -1, 1).alias("tail"))
    w = W.partitionBy(*TEXT).orderBy("at")  # a few letters for each piece
    near = ends.withColumn("more", F.substring(F.array_join(F.collect_list("head").over(w.rowsBetween(1, word)), ""), 1, word - 1)).withColumn("prev", F.lag("tail").over(w)).drop("head", "tail")
    p = pieces.join(near, [*TEXT, "at"]).withColumn("long", F.concat("seq", "more"))
    x = p.select(*TEXT, "at", "long", "prev", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("i"))
    letter = F.when(F.col("i") > 0, F.substring("long", F.col("i"), F.lit(1))).otherwise(F.col("prev"))
    before = F.when(letter.isNull(), _end()).otherwise(F.ascii(letter).cast("bigint"))
    return x.select(*TEXT, (F.col("at") + F.col("i")).alias("place"), F.substring("long", F.col("i") + 1, F.lit(word)).alias("word"), before.alias("before"))


def _end():
    """A number below 0 for each text of a group."""
    return (-1 - 2 * F.col("seq_idx") - F.col("fwd").cast("int")).cast("bigint")


def ranks(rows: DataFrame, scratch: Scratch, word: int = WORD, width: int = WIDTH) -> tuple[DataFrame, list[DataFrame]]:
    """Every suffix with its rank (grp, seq_idx, fwd, place, rank) in the order of its group, and for each round the suffixes
    that are not alone in their class after it, with the class's rank."""
    at = [*TEXT, "place"]
    code = F.conv(F.hex(F.rpad("word", word, "\0")), 16, 10).cast("bigint")  # letters are single bytes below 128
    tagged = rows.select(*at, code.alias("code"), F.when(F.length("word") < word, _end()).otherwise(F.lit(0)).alias("tag"))
    classes = tagged.groupBy("grp", "code", "tag").agg(F.count("*").alias("n"))
    firsts = running_sum(classes, ["grp"], ["code", "tag"], F.col("n"), "upto", 1 << 40).select("grp", "code", "tag", "n", (F.col("upto") - F.col("n")).alias("rank"))
    now = scratch.keep(tagged.join(firsts, ["grp", "code", "tag"]).select(*at, "rank", "n"))
    done, levels, h = [now.where("n = 1").select(*at, "rank")], [], word
    while True:
        open_ = now.where("n > 1").select(*at, "rank")
        if open_.isEmpty():
            break
        levels.append(open_)
        known = open_
        for d in done:
            known = known.unionByName(d)
        later = known.select(*TEXT, (F.col("place") - h).alias("place"), F.col("rank").alias("r2")).where("place >= 0")
        pairs = open_.join(later, at, "left").withColumn("r2", F.coalesce("r2", _end()))
        counts = scratch.keep(pairs.groupBy("grp", "rank", "r2").agg(F.count("*").alias("n")))
        upto = running_sum(counts, ["grp", "rank"], ["r2"], F.col("n"), "upto", width).withColumn("new", F.col("rank") + F.col("upto") - F.col("n"))
        now = scratch.keep(pairs.join(upto.select("grp", "rank", "r2", "n", "new"), ["grp", "rank", "r2"]).select(*at, F.col("new").alias("rank"), "n"))
        done.append(now.where("n = 1").select(*at, "rank"))
        h *= 2
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every, levels


def common_prefixes(order: DataFrame, levels: list[DataFrame], rows: DataFrame, scratch: Scratch, word: int = WORD, width: int = WIDTH) -> DataFrame:
    """grp, rank, seq_idx, fwd, place, lcp: suffixes that share ``word`` letters with a neighbour, by rank, and how many letters
    each shares with the one before it (less than ``word``: 0)."""
    at = [*TEXT, "place"]
    first = levels[0].withColumnRenamed("rank", "class")
    s = scratch.keep(order.join(first, at))
    me, you = F.struct("seq_idx", "fwd", "place").alias("me"), F.col("next.me").alias("you")
    n = with_next(s.select("grp", "rank", "class", me), ["grp"], ["rank"], ["rank", "class", "me"], width=width).where("next.class = class")
    pairs = n.select("grp", F.col("next.rank").alias("rank"), "me", you, F.lit(0).cast("bigint").alias("off"))

    def look(df: DataFrame, of: DataFrame, value: str) -> DataFrame:
        """``df`` with ``value`` of both suffixes, ``off`` letters on."""
        for who in ("me", "you"):
            side = of.select(F.col("grp").alias("_g"), F.col("seq_idx").alias("_s"), F.col("fwd").alias("_f"), F.col("place").alias("_p"), F.col(value).alias(f"_{who}"))
            on = (F.col("grp") == F.col("_g")) & (F.col(f"{who}.seq_idx") == F.col("_s")) & (F.col(f"{who}.fwd") == F.col("_f")) & (F.col(f"{who}.place") + F.col("off") == F.col("_p"))
            df = df.join(side, on, "left").drop("_g", "_s", "_f", "_p")
        return df

    for t in reversed(range(len(levels))):
        same = F.coalesce(F.col("_me") == F.col("_you"), F.lit(False))
        pairs = look(pairs, levels[t], "rank").withColumn("off", F.col("off") + F.when(same, F.lit(word << t)).otherwise(F.lit(0))).drop("_me", "_you")
        if t % 3 == 0:
            pairs = scratch.keep(pairs)
    some = sum(F.when((F.length("_me") >= i) & (F.length("_you") >= i) & (F.substring("_me", 1, i) == F.substring("_you", 1, i)), 1).otherwise(0) for i in range(1, word + 1))
    got = look(pairs, rows, "word").select("grp", "rank", (F.col("off") + F.coalesce(some, F.lit(0))).alias("lcp"))
    return s.drop("class").join(got, ["grp", "rank"], "left").withColumn("lcp", F.coalesce("lcp", F.lit(0)))


def unique_matches(pieces: DataFrame, least: int, both_strands: bool = False, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """grp, match, seq_idx, pos, length, strand: the rows of :func:`matching.multi_matches`, for groups of any size.

    ``pieces`` (grp, seq_idx, at, seq) are the sequences of each group, end to end from 0, letters being single bytes.
    """
    scratch = Scratch(pieces.sparkSession)
    try:
        return shared(_unique_matches(pieces, least, both_strands, block, width, scratch))
    finally:
        scratch.close()


def _unique_matches(pieces: DataFrame, least: int, both_strands: bool, block: int, width: int, scratch: Scratch) -> DataFrame:
    word = min(WORD, least)
    cut, sizes = texts(pieces, both_strands, scratch)
    rows = scratch.keep(suffixes(cut, word))
    order, levels = ranks(rows, scratch, word, width)
    groups = sizes.groupBy("grp").agg(F.count("*").alias("genomes"), F.min("n").alias("shortest"), F.min("seq_idx").alias("first_seq"))
    groups = scratch.keep(groups.where((F.col("genomes") > 1) & (F.col("shortest") >= least)))
    kind = pieces.schema["grp"].dataType.simpleString()
    if not levels or groups.isEmpty():
        return pieces.sparkSession.createDataFrame([], f"grp {kind}, match bigint, seq_idx int, pos bigint, length bigint, strand boolean")
    near = common_prefixes(order, levels, rows, scratch, word, width).join(rows.select(*TEXT, "place", "before"), [*TEXT, "place"]).join(groups, "grp")
    near = scratch.keep(near)
    found = None
    for genomes in sorted(r.genomes for r in groups.select("genomes").distinct().collect()):  # at most as many as genomes
        for m in (genomes, 2 * genomes) if both_strands else (genomes,):
            more = _blocks(near.where(F.col("genomes") == genomes), m, least, block)
            found = more if found is None else found.unionByName(more)
    found = scratch.keep(found)
    members = found.select("grp", "first", "m", "long", F.explode(F.sequence("first", F.col("first") + F.col("m") - 1)).alias("rank")).join(near.drop("lcp"), ["grp", "rank"])
    letters = rows.select(*TEXT, (F.col("place") - 0).alias("_p"), F.ascii("word").cast("bigint").alias("after"))
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in TEXT] + [F.col("a.place") + F.col("a.long") == F.col("b._p")]
    members = members.alias("a").join(letters.alias("b"), on, "left").select("a.*", "after").withColumn("after", F.coalesce("after", _end()))
    members = members.join(sizes, ["grp", "seq_idx"])
    members = members.withColumn("start", F.when(F.col("fwd"), F.col("place")).otherwise(F.col("n") - F.col("place") - F.col("long")))
    forward = lambda c: F.when(F.col("fwd"), F.col(c))
    stats = members.groupBy("grp", "first", "m", "long").agg(
        F.first("genomes").alias("genomes"),
        F.countDistinct("seq_idx").alias("seqs"),
        F.countDistinct("seq_idx", "start").alias("places"),
        F.countDistinct("seq_idx", "fwd").alias("sides"),
        F.max(forward("seq_idx") == F.col("first_seq")).alias("leads"),
        *[f(forward(c)).alias(f"{name}_{c}") for c in ("before", "after") for f, name in ((F.min, "low"), (F.max, "high"))],
        F.array_sort(F.collect_set(F.struct("seq_idx", "start", F.when(F.col("m") == F.col("genomes"), F.col("fwd")).otherwise(F.lit(True)).alias("strand")))).alias("rows"),
    )
    plain = (F.col("m") == F.col("genomes")) & (F.col("seqs") == F.col("genomes")) & F.coalesce("leads", F.lit(False))
    palindrome = (F.col("m") == 2 * F.col("genomes")) & (F.col("places") == F.col("genomes")) & (F.col("sides") == F.col("m"))
    palindrome = palindrome & (F.col("low_before") != F.col("high_before")) & (F.col("low_after") != F.col("high_after"))
    good = stats.where(plain | palindrome).select("grp", F.col("long").alias("length"), "rows", F.col("rows")[0]["start"].alias("s0"), F.transform("rows", lambda r: r["start"]).alias("starts"))
    numbered = ranked(good, ["grp"], ["s0", "starts", "length"], "match", width)
    return numbered.select("grp", F.col("match").cast("bigint").alias("match"), "length", F.explode("rows").alias("r")).select("grp", "match", "r.seq_idx", F.col("r.start").alias("pos"), "length", F.col("r.strand").alias("strand"))


def _blocks(near: DataFrame, m: int, least: int, block: int) -> DataFrame:
    """grp, first, m, long: runs of m neighbouring suffixes that share ``long`` letters, more than with any other suffix, and
    whose letters before are not all the same."""
    own = F.floor(F.col("rank") / block).cast("bigint")
    to = F.when(F.col("rank") % block <= m, F.array(own, own - 1)).otherwise(F.array(own))  # the next block's first rows come along
    x = near.select("grp", "rank", "lcp", "before", own.alias("own"), F.explode(to).alias("blk"))
    w = W.partitionBy("grp", "blk").orderBy("rank")
    inside, whole = w.rowsBetween(1, m - 1), w.rowsBetween(0, m - 1)
    y = x.select(
        "grp",
        F.col("rank").alias("first"),
        "lcp",
        "own",
        "blk",
        F.min("lcp").over(inside).alias("long"),
        F.count("lcp").over(inside).alias("have"),
        F.coalesce(F.lead("lcp", m).over(w), F.lit(0)).alias("next"),
        (F.min("before").over(whole) != F.max("before").over(whole)).alias("left"),
    )
    return y.where((F.col("own") == F.col("blk")) & (F.col("have") == m - 1) & (F.col("long") >= least) & (F.col("lcp") < F.col("long")) & (F.col("next") < F.col("long")) & F.col("left")).select("grp", "first", F.lit(m).alias("m"), "long")
