"""Hand-computed cases and randomised comparisons with plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from anchorframe.functions import scalar
from anchorframe.functions.ordered import asof, asof_next, ranked, running_sum, with_next
from anchorframe.operators import collinear, coords, gaps, intervals, layout, liftover, matching

MUMS = "mum_id bigint, seq_idx int, start bigint, length bigint, strand boolean"


@pytest.fixture(scope="module")
def micro(spark):
    """Three genomes of one contig; rows 0 to 2 are chained everywhere, inverted in the last genome."""
    table = {0: (20, [100, 110, 600], "++-"), 1: (30, [200, 215, 500], "++-"), 2: (10, [300, 320, 400], "++-"), 3: (25, [500, 700, 100], "+++"), 4: (15, [600, 650, -1], "+++")}
    rows = [(m, j, s, n, d[j] == "+") for m, (n, starts, d) in table.items() for j, s in enumerate(starts)]
    return spark.createDataFrame(rows, MUMS).cache()


def region(spark, *rows):
    return spark.createDataFrame([(i, 0, a, b) for i, (a, b) in enumerate(rows)], "region_id bigint, seq_idx int, start bigint, end bigint")


def test_overlap_is_half_open(spark, micro):
    got = intervals.overlap_join(region(spark, (215, 310), (120, 200)), micro, 64)
    assert sorted((r.region_id, r.mum_id) for r in got.collect()) == [(0, 1), (0, 2)]


def test_bounds_and_liftover(spark, micro):
    regions = region(spark, (215, 310), (150, 450), (0, 50), (590, 5000))
    b = {r.region_id: r for r in liftover.offsets(liftover.bounds(regions, micro, 64)).collect()}
    assert set(b) == {0, 1}  # nothing starts before region 2 or ends after region 3
    assert (b[0].left_id, b[0].right_id, b[0].left_off, b[0].right_off, b[0].left_margin, b[0].right_margin) == (1, 2, 15, 9, 0, 0)
    assert (b[1].left_id, b[1].right_id, b[1].left_margin, b[1].right_margin) == (0, 3, 31, 51)
    lifted = {(r.region_id, r.seq_idx): (r.start, r.end_incl, r.orientation) for r in liftover.liftover(regions, micro, 64).collect()}
    assert lifted[0, 1] == (230, 329, "+") and lifted[0, 2] == (515, 409, "-") and lifted[1, 1] == (110, 700, "+")


def test_blocks_and_gaps(spark, micro):
    blocks = collinear.collinear_blocks(micro, 3, 2)
    assert [(r.s, r.e) for r in blocks.collect()] == [(0, 2)]
    g = {(r.gap, r.seq_idx): r.gap_len for r in gaps.gaps(blocks, micro).collect()}
    assert g == {(0, 0): 80, (0, 1): 85, (0, 2): 70, (1, 0): 70, (1, 1): 75, (1, 2): 90}


def test_renumbered_blocks_do_not_drift(spark):
    blocks = spark.createDataFrame([(0, 2), (5, 6), (10, 13)], "s bigint, e bigint")
    assert sorted((r.new_s, r.new_e) for r in collinear.renumbered(blocks, 4).collect()) == [(0, 2), (3, 4), (5, 8)]


def test_runs_skip_absent_rows(spark, micro):
    runs = {(r.seq_idx, r.bin, r.lo, r.hi) for r in layout.bin_runs(micro, 250, 2).collect()}
    assert {r for r in runs if r[0] == 2} == {(2, 2, 0, 2), (2, 1, 2, 3), (2, 0, 3, 4)}


def test_order_helpers_match_python(spark):
    r = random.Random(5)
    rows = [(r.randrange(3), r.randrange(200), i) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, x bigint, i bigint").cache()
    by = {k: sorted((x, i) for kk, x, i in rows if kk == k) for k in range(3)}
    nxt = {r.i: r.next and r.next.i for r in with_next(df, ["k"], ["x", "i"], ["i"], width=16).collect()}
    assert nxt == {i: (v[p + 1][1] if p + 1 < len(v) else None) for v in by.values() for p, (_, i) in enumerate(v)}
    rank = {r.i: r.n for r in ranked(df, ["k"], ["x", "i"], "n", 16).collect()}
    assert rank == {i: p for v in by.values() for p, (_, i) in enumerate(v)}
    sums = {r.i: r.s for r in running_sum(df, ["k"], ["x", "i"], F.col("x"), "s", 16).collect()}
    assert all(sums[v[p][1]] == sum(x for x, _ in v[: p + 1]) for v in by.values() for p in range(len(v)))
    q = spark.createDataFrame([(k, a) for k in range(3) for a in (-5, 0, 40, 77, 150, 500)], "k int, a bigint").cache()
    back = {(r.k, r.a): r.v and r.v.i for r in asof(q, df, ["k"], "a", ["x", "i"], ["i"], "v", 16).collect()}
    fore = {(r.k, r.a): r.v and r.v.i for r in asof_next(q, df, ["k"], "a", ["x", "i"], ["i"], "v", 16).collect()}
    for (k, a), i in back.items():
        assert i == max((v for v in by[k] if v[0] <= a), default=(0, None))[1]
    for (k, a), i in fore.items():
        assert i == min((v for v in by[k] if v[0] >= a), default=(0, None))[1]


def test_coordinates(spark):
    c = spark.createDataFrame([(0, 0, "a:1", 100, 0, "p"), (0, 1, "b", 50, 100, "p")], "seq_idx int, contig_idx int, contig string, length bigint, offset bigint, path string").cache()
    r = spark.createDataFrame([(0, 0, "a:1:10-20"), (1, 0, "b:40-60"), (2, 0, "x:1-2"), (3, 0, "b:0-50")], "region_id bigint, seq_idx int, region string")
    g = {x.region_id: (x.g_start, x.g_end_incl, x.reason) for x in coords.to_global(r, c).collect()}
    assert g == {0: (10, 19, None), 1: (None, None, "out of range"), 2: (None, None, "unknown contig"), 3: (100, 149, None)}
    i = spark.createDataFrame([(0, 0, 90, 110), (1, 0, 100, 149), (2, 0, 140, 150)], "i int, seq_idx int, start bigint, end_incl bigint")
    out = {x.i: (x.contig, x.l_start, x.l_end, x.reason) for x in coords.to_local(i, c).collect()}
    assert out == {0: (None, None, None, "cross contig"), 1: ("b", 0, 50, None), 2: (None, None, None, "out of range")}


def test_names(spark):
    df = spark.createDataFrame([("/x/a.b.fa", "s p:1"), ("plain", "__..")], "p string, t string")
    got = [(r.n, r.s) for r in df.select(scalar.extract_name(F.col("p")).alias("n"), scalar.safe_name(F.col("t")).alias("s")).collect()]
    assert got == [("a.b_extract.fa", "s_p_1"), ("plain_extract.fa", "region")]


def test_multi_matches_match_brute_force(spark):
    r = random.Random(3)
    for _ in range(2):
        core = "".join(r.choice("acgt") for _ in range(30))
        s = [core[:14] + "".join(r.choice("acgt") for _ in range(8)) + core[14:] for _ in range(3)]
        k = 6
        want = set()
        for a in range(len(s[0])):
            for b in range(a + k, len(s[0]) + 1):
                t = s[0][a:b]
                at = [[i for i in range(len(x) - len(t) + 1) if x.startswith(t, i)] for x in s]
                if all(len(x) == 1 for x in at):
                    left = len({x[i[0] - 1] if i[0] else f"^{j}" for j, (x, i) in enumerate(zip(s, at, strict=True))}) > 1 or any(i[0] == 0 for i in at)
                    right = len({x[i[0] + len(t)] if i[0] + len(t) < len(x) else f"${j}" for j, (x, i) in enumerate(zip(s, at, strict=True))}) > 1 or any(i[0] + len(t) == len(x) for x, i in zip(s, at, strict=True))
                    if left and right:
                        want |= {(j, i[0], len(t)) for j, i in enumerate(at)}
        df = spark.createDataFrame([(0, j, x) for j, x in enumerate(s)], "g int, seq_idx int, seq string")
        assert {(x.seq_idx, x.pos, x.length) for x in matching.multi_matches(df, "g", k).collect()} == want


def test_split_multifasta_keeps_whole_texts(spark, tmp_path):
    from anchorframe.plans import catalogue

    texts = {1: "", 2: "short", 3: "x" * 30, 4: "ab>c " * 70, 8: "é" * 61, 11: "y" * 60}
    spark.createDataFrame(list(texts.items()), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.file_id, r.record, r.header, r.seq) for r in catalogue.split_multifasta(spark, str(tmp_path)).collect())
    want = []
    for f in range(7):
        want += [(f, k, f">r{i}", texts[i].replace(">", "")) for k, i in enumerate(i for i in sorted(texts) if i % 7 == f)]
    assert got == want


def test_narrow_bins_hold_all_matches(spark, tmp_path):
    from anchorframe.plans import adapters, catalogue

    d, w = str(tmp_path), catalogue.NARROW
    spark.createDataFrame([(i, i * 7 % 50) for i in range(400)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(i, i % 25) for i in range(60)], "s_suppkey bigint, s_nationkey bigint").write.parquet(f"{d}/supplier.parquet")
    spans = {}
    for m in adapters.mums(spark, d).collect():
        lo, hi = spans.get((m.seq_idx, m.start // w), (m.start, 0))
        spans[m.seq_idx, m.start // w] = min(lo, m.start), max(hi, m.start + m.length)
    near, flank = {}, {}
    for r in adapters.regions(spark, d).collect():
        bins = sorted(b for j, b in spans if j == r.seq_idx)
        left = [b for b in bins if b <= r.start // w][::-1]
        right = [b for b in bins if b >= r.start // w]
        near[r.region_id] = next(iter(left), None), next(iter(right), None)
        right = [b for b in bins if b >= (r.end - 1) // w]
        flank[r.region_id] = (
            next((b for b in left[:2] if spans[r.seq_idx, b][0] <= r.start), None),
            next((b for b in right[:2] if spans[r.seq_idx, b][1] > r.end - 1), None),
        )
    assert near == {r.region_id: (r.left_bin, r.right_bin) for r in catalogue.nearest_nonempty_bin(spark, d).collect()}
    assert flank == {r.region_id: (r.left_bin, r.right_bin) for r in catalogue.flank_bins(spark, d).collect()}


def test_short_items_have_multi_mums(spark, tmp_path):
    from anchorframe.plans import catalogue

    texts = {1: "q" * 15, 2: "abcdefhgjikmlaonpdqgrstvuxywzcbaedfghkji", 3: "tgca"}
    spark.createDataFrame(list(texts.items()), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    t = "".join("acgt"[(ord(c) - 97) % 4] for c in texts[2])
    s, k, want = [t, t[20:] + t[:20], "acgtta" + t + "ttgaca"], 16, set()
    for a in range(len(t)):
        for b in range(a + k, len(t) + 1):
            at = [[i for i in range(len(x)) if x.startswith(t[a:b], i)] for x in s]
            if all(len(i) == 1 for i in at):
                ends = [(x[i[0] - 1] if i[0] else None, x[i[0] + b - a] if i[0] + b - a < len(x) else None) for x, i in zip(s, at, strict=True)]
                if all(len({e[side] for e in ends}) > 1 or None in {e[side] for e in ends} for side in (0, 1)):
                    want |= {(2, j, i[0], b - a) for j, i in enumerate(at)}
    assert want
    assert {(x.grp, x.seq_idx, x.pos, x.length) for x in catalogue.multi_mums(spark, str(tmp_path)).collect()} == want


def test_present_sequences_are_not_missing(spark, tmp_path):
    from anchorframe.plans import catalogue

    docs = [(1, "abc", 3, "p"), (2, "abcd", 4, "p"), (3, "abcdef", 6, "q")]
    spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.path, r.contig) for r in catalogue.fasta_missing(spark, str(tmp_path)).collect())
    assert got == [("p.absent", "doc1"), ("p.absent", "doc2"), ("q.absent", "doc3")]


def test_entry_module_without_extras(spark):
    import __spark_entry__ as e

    assert "extract_bed" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_oriented_blocks_of_a_hundred_genomes(spark):
    """Forward, reversed and broken chains, in more genomes than a number has bits."""
    n, rows = 100, 24
    place = {j: list(range(rows)) if j % 3 else list(range(rows))[::-1] for j in range(n)}
    place[70][10], place[70][11] = place[70][11], place[70][10]
    flip = {(j, i) for j in (64, 99) for i in range(16, rows)}  # these genomes turn over the tail's matches in place
    table = [(i, j, place[j][i] * 100, 20, (j % 3 != 0) != ((j, i) in flip)) for j in range(n) for i in range(rows)]
    mums = spark.createDataFrame(table, "mum_id bigint, seq_idx int, start bigint, length bigint, strand boolean")

    def together(l):
        for j in range(n):
            a, b = (next(t for t in table if t[0] == k and t[1] == j) for k in (l, l + 1))
            if a[4] != b[4] or b[2] - a[2] != (100 if a[4] else -100):
                return False
        return True

    chained = [together(i) for i in range(rows - 1)]
    want, i = [], 0
    while i < rows - 1:
        if chained[i]:
            s = i
            while i < rows - 1 and chained[i]:
                i += 1
            want.append((s, i))
        i += 1
    got = collinear.oriented_blocks(mums, n).orderBy("block").collect()
    assert [(r.s, r.e) for r in got] == want and len(want) == 2
    assert collinear.walk_steps(collinear.oriented_blocks(mums, n), mums).where("seq_idx = 99 and direction = '-'").count() == 2
    assert collinear.rearranged(collinear.oriented_blocks(mums, n), mums).count() >= 0
