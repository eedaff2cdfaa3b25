"""Registered queries against their SQL on small tables made for one case."""

import random

import duckdb

import __spark_entry__ as entry
from anchorframe.functions import ordered, runs, suffixes
from anchorframe.operators import graph, matching, segment
from anchorframe.plans import adapters, catalogue

SF = "/root/testdata/sf0.001"


def tables(spark, folder, sf=SF, **made):
    """A folder with the tables of ``sf``, those of ``made`` (DataFrames) in their place."""
    for name in ("orders", "supplier", "nation", "documents", "benchmark"):
        df = made.get(name) if name in made else spark.read.parquet(f"{sf}/{name}.parquet")
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same_as_sql(spark, name, d):
    df = entry.queries()[name](spark, d)
    con = duckdb.connect()
    for t in ("orders", "supplier", "nation", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: [(x is not None, x) for x in r]
    got = sorted((tuple(r) for r in df.collect()), key=key)
    assert got == sorted(want, key=key)
    return got


def test_match_table_is_not_taken_for_small(spark):
    """Joins with blocks broadcast the match table at six times sf0.1, as its estimate was that of the orders file."""
    m = adapters.mums(spark, "/root/testdata/sf0.1")
    assert m._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 20 * 750_000


def test_stranded_match_that_is_its_own_reverse_complement(spark, tmp_path):
    """A match of item 169 stands on both strands of one place, so SQL does not call it unique."""
    b = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").where("item_id in (168, 169)")
    assert same_as_sql(spark, "multi_mums_stranded", tables(spark, tmp_path, benchmark=b))


def test_bins_are_searched_without_summing_up_all(spark, tmp_path):
    """Every bin of the table was summed up and written before a few of them were looked at."""
    assert "Aggregate" not in catalogue._sparse(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    d = tables(spark, tmp_path)
    same_as_sql(spark, "nearest_nonempty_bin", d)
    same_as_sql(spark, "flank_bins", d)


def test_alleles_are_numbered_in_one_exchange(spark):
    """Sequences were numbered apart and joined back."""
    rows = [(1, 0, "c"), (1, 1, "a"), (1, 2, "c"), (1, 3, ""), (2, 2, "a"), (2, 4, None)]
    a = graph.alleles(spark.createDataFrame(rows, "k int, seq_idx int, seq string"), ["k"])
    assert "Join" not in a._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.k, r.seq_idx, r.seq, r.allele) for r in a.collect()) == [(1, 0, "c", 0), (1, 1, "a", 1), (1, 2, "c", 0), (1, 3, "", 2), (2, 2, "a", 0)]


def _random_groups(seed, cases):
    r = random.Random(seed)
    for _ in range(cases):
        base = [r.choice("ACGT"[: r.randint(1, 4)]) for _ in range(r.randint(0, 120))]
        out = []
        for _ in range(r.randint(0, 5)):
            x = base[:]
            for _ in range(r.randint(0, 3) if x else 0):
                x[r.randrange(len(x))] = r.choice("ACGTN")
            out.append("".join(x).encode() if r.random() < 0.7 else suffixes.reverse_complement("".join(x).encode()))
        yield out


def test_many_groups_match_as_one_by_one():
    """Groups had a suffix array each, built one after another, which was two thirds of enhanced_gaps' time."""
    groups = list(_random_groups(1, 150))
    for least in (1, 3, 9, 33, 70):
        for both, palindromes in ((False, True), (True, True), (True, False)):
            assert suffixes.once_in_each_of(groups, least, both, palindromes) == [suffixes.once_in_each(g, least, both, palindromes) for g in groups]


def test_groups_without_repeats_need_no_suffix_array(monkeypatch):
    """What stands once in each sequence is extended in place; only groups that repeat their letters are sorted as a whole."""
    calls = []
    monkeypatch.setattr(suffixes, "suffix_array", lambda codes, own=suffixes.suffix_array: calls.append(len(codes)) or own(codes))
    r = random.Random(2)
    texts = ["".join(r.choice("ACGT") for _ in range(200)).encode() for _ in range(20)]
    found = suffixes.once_in_each_of([[t, t[:100] + b"N" + t[100:]] for t in texts], 20, True)
    assert all(len(x) == 2 for x in found) and not calls
    twice = [texts[0] + texts[0], texts[0] + b"N" + texts[0]]
    assert suffixes.once_in_each_of([twice], 20, True) == [suffixes.once_in_each(twice, 20, True)] and calls


def test_groups_over_many_arrow_batches(spark, monkeypatch):
    """A group whose rows lie in two Arrow batches is matched as one, and batches of groups do not mix their matches."""
    monkeypatch.setattr(matching, "LETTERS", 500)
    groups = [g for g in _random_groups(3, 60) if g]
    rows = [(j if j else None, i, x.decode()) for j, g in enumerate(groups) for i, x in enumerate(g)] + [(5, 9, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = matching.multi_matches(spark.createDataFrame(rows, "grp long, seq_idx int, seq string"), "grp", 9, both_strands=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(j if j else None, m, i, p, n, f) for j, g in enumerate(groups) for m, (n, starts, forward) in enumerate(suffixes.once_in_each(g, 9, True)) for i, (p, f) in enumerate(zip(starts, forward, strict=True))]
    key = lambda x: [(v is not None, v) for v in x]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and want


def test_inner_links_are_the_steps_of_the_walks_without_joining_the_match_table_again(spark, tmp_path):
    """Blocks were made twice and their anchors, directions and nodes joined and put in order; those tables were broadcast."""
    blocks = spark.createDataFrame([(0, 3, 5, 3), (1, 9, 10, 2)], "block long, s long, e long, n long")
    rows = [(m, g, 100 * m if g < 2 else 5000 - 100 * m, 20, g < 2) for m in range(12) for g in range(3)]
    mums = spark.createDataFrame(rows, "mum_id long, seq_idx int, start long, length long, strand boolean")
    between = graph.inner_intervals(blocks, mums).selectExpr("*", "case when gap = 1 then null when seq_idx = 1 then '' else 'ac' end as seq")
    nodes = graph.bubble_nodes(between.select("block", "gap", "seq_idx", "seq"))
    want = {tuple(r) for r in graph.node_links(graph.block_walk(blocks, mums, nodes)).collect()}
    got = graph.inner_links(between)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert ("oblock0_m5", "-", "oblock0_m4", "-") in want and ("oblock0_m3", "+", "oblock0_m4", "+") in want and ("oblock1_g0_a0", "-", "oblock1_m9", "-") in want
    assert "Window" not in catalogue.block_walk_links(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert same_as_sql(spark, "block_walk_links", tables(spark, tmp_path))


def test_stretches_between_blocks_read_the_match_table_once(spark, tmp_path):
    """One plan joined the match table sixteen times, and the driver broadcast the rows to which the next ones were put."""
    d = tables(spark, tmp_path)
    q = catalogue.interblock_walks(spark, d)._jdf.queryExecution()
    assert "parquet" not in q.optimizedPlan().toString() and "BroadcastHashJoin" not in q.executedPlan().toString()
    n = ordered.with_next(spark.range(1000), [], ["id"], ["id"], width=64)
    assert n.where("next.id = id + 1").count() == 999 and "Broadcast" not in n._jdf.queryExecution().executedPlan().toString()
    assert same_as_sql(spark, "interblock_walks", d) and same_as_sql(spark, "rearranged_blocks", d)


def test_contig_breaks_of_a_chain_are_found_without_broadcasting_the_chain(spark, tmp_path):
    """Rows of the chain were joined to the match table twice and to their followers once more, and broadcast for it up to the session's limit."""
    r = random.Random(4)
    contigs = {g: [(k, 50 * k + 10 * g * (k > 0), 50 + 10 * g * (k == 0)) for k in range(8)] for g in range(3)}  # number, offset, length
    starts = {(m, g): -1 if r.random() < 0.2 else r.randint(0, 420) for m in range(60) for g in range(3)}
    rows = sorted(r.sample(range(60), 45))
    inside = lambda g, x: next(((k, x - o) for k, o, n in contigs[g] if o <= x < o + n), None)
    want = {}
    for m, after in zip(rows, [*rows[1:], None], strict=True):
        here = [(inside(g, starts[m, g] + 10), inside(g, starts[after, g]) if after is not None and starts[after, g] >= 0 else None) for g in range(3) if starts[m, g] >= 0]
        want[m] = any(e is None or e[1] == 0 or (n is not None and e[0] != n[0]) for e, n in here)
    chain = spark.createDataFrame([(m,) for m in rows], "mum_id long")
    mums = spark.createDataFrame([(m, g, s, 10, True) for (m, g), s in starts.items()], "mum_id long, seq_idx int, start long, length long, strand boolean")
    table = spark.createDataFrame([(g, k, f"c{k}", n, o) for g, x in contigs.items() for k, o, n in x], "seq_idx int, contig_idx int, contig string, length long, offset long")
    got = segment.contig_breaks(chain, mums, table, 16)
    assert {x.mum_id: x.brk for x in got.collect()} == want and len(set(want.values())) == 2
    d = tables(spark, tmp_path)
    for name in ("contig_breaks", "shred_cuts", "shred_intervals"):
        assert same_as_sql(spark, name, d)
    assert "BroadcastHashJoin [mum_id" not in got._jdf.queryExecution().executedPlan().toString()


def _shuffled_rows(spark):
    none = getattr(spark._jvm.java.util, "ArrayList")()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_kmers_that_the_right_side_lacks_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Beyond what is broadcast, every k-mer of the documents went through an exchange."""
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 1000)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    d = tables(spark, tmp_path)
    b, t = (spark.read.parquet(f"{d}/{x}.parquet").where("length(text) >= 24") for x in ("benchmark", "documents"))
    right, left = (x.selectExpr("sum(length(text) - 23)").first()[0] for x in (b, t))
    before = _shuffled_rows(spark)
    try:
        got = catalogue.pairwise_mems(spark, d).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    shuffled = _shuffled_rows(spark) - before
    hits = sum(r.length - 23 for r in got)
    assert right > 1000 and hits and left > 40 * hits
    assert shuffled < 5 * right + 20 * hits + 1000 < left
    assert same_as_sql(spark, "pairwise_mems", d)


def test_kmer_that_both_sides_repeat(spark):
    """Every pair of occurrences was made, 10,000,000,000 of them here, though a diagonal has one match."""
    n, k = 100_000, 24
    one = lambda i, x: spark.createDataFrame([(i, x)], "seq_id long, seq string")
    got = matching.pairwise_mems(one(1, "b" + "a" * n), one(2, "a" * n), k).collect()
    assert len(got) == len({(r.a_pos, r.b_pos) for r in got}) == 2 * (n - k) + 1
    assert all(min(r.a_pos - 1, r.b_pos) == 0 and r.length == n - max(r.a_pos - 1, r.b_pos) and (r.a, r.b) == (1, 2) for r in got)


def test_matches_of_odd_texts_are_those_of_sql(spark, tmp_path, monkeypatch):
    """Lengths around k, letters of one to four bytes, runs, repeats, equal texts, matches over the bounds of pieces."""
    r = random.Random(5)
    for case, (piece, letters) in enumerate(((3, "ab"), (64, "aÄж\U0001f600"), (512, "AbcdÉß \n"))):
        monkeypatch.setattr(matching, "PIECE", piece)
        base = ["".join(r.choice(letters) for _ in range(n)) for n in (0, 23, 24, 25, 60, 400)] + [letters[0] * 90, letters[0] * 40 + letters[1], None]
        docs = [*base, *("".join(r.choice(letters) for _ in range(r.randint(0, 30))) + r.choice([x for x in base if x]).upper()[r.randint(0, 20) :] * r.randint(1, 2) for _ in range(20))]
        documents = spark.createDataFrame([(i, x) for i, x in enumerate(docs)], "doc_id long, text string")
        benchmark = spark.createDataFrame([(100 + i, x) for i, x in enumerate(base)], "item_id long, text string")
        assert len(same_as_sql(spark, "pairwise_mems", tables(spark, tmp_path / str(case), documents=documents, benchmark=benchmark))) > 20
    none = tables(spark, tmp_path / "none", benchmark=benchmark.where("item_id < 0"))
    assert same_as_sql(spark, "pairwise_mems", none) == []


def test_stretches_that_may_match_are_found_over_block_bounds(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 7)
    r = random.Random(6)
    for k in (1, 2, 5, 24, 37):
        known, texts = (["".join(r.choice("abcdÄ") for _ in range(r.choice((0, 3, 50, 90)))) for _ in range(30)] for _ in range(2))
        texts[3:6] = [known[0] + known[1], "x" * 40 + "".join(known) + "x" * 40, ""]
        filter_ = runs.np.zeros(1 << 16, runs.np.uint8)
        runs.add(filter_, known, k)
        whole = "".join(known)  # runs over the ends of texts are let through as well
        want, there = [], {whole[i : i + k] for i in range(len(whole) - k + 1)}
        for i, x in enumerate(texts):
            hits = [p for p in range(len(x) - k + 1) if x[p : p + k] in there]
            for p in hits:
                if want and want[-1][0] == i and want[-1][2] - k + 1 == p:
                    want[-1][2] += 1
                else:
                    want.append([i, p, p + k])
        got = runs.stretches(filter_, texts, k)
        assert got == [tuple(x) for x in want] and want
    assert [runs.bits_for(n) for n in (0, 1 << 17, 1 << 18, 1 << 30)] == [22, 22, 23, 27]
