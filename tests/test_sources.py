import os
import random
import struct

import numpy as np
import pytest

from anchorframe.operators import intervals, layout
from anchorframe.sources import binindex, matchfile, text
from anchorframe.streaming.regions import REGIONS, stream_overlaps


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(1)
    rows = [(i, j, -1 if j == 1 and i % 5 == 0 else i * 100 + r.randrange(40), 20 + i % 7, r.random() < 0.8) for i in range(45) for j in range(3)]
    return spark.createDataFrame(rows, matchfile.SCHEMA).cache()


def test_match_file_round_trip(spark, table, tmp_path):
    path = str(tmp_path / "m.bin")
    matchfile.write(table, path, [(0, 3), (5, 9)])
    matchfile.register(spark)
    back = spark.read.format("matchfile").option("rows", 16).load(path)
    assert sorted(back.collect()) == sorted(table.collect())
    assert sorted(back.where("mum_id >= 20 and mum_id < 23").collect()) == sorted(table.where("mum_id between 20 and 22").collect())
    h = matchfile.read_header(path)
    assert (h.n_seqs, h.n_rows, h.num_blocks) == (3, 45, 2)
    assert [(r.s, r.e) for r in matchfile.read_blocks(spark, path).collect()] == [(0, 3), (5, 9)]


def test_index_round_trip(spark, table, tmp_path):
    path = str(tmp_path / "i.bi")
    binindex.write_all(table, 500, path)
    assert binindex.verify(table, path) and not binindex.verify(table.selectExpr("mum_id", "seq_idx", "start", "length + 1 as length", "strand"), path)
    spans = {(r.seq_idx, r.bin): (r.span_min, r.span_max) for r in layout.bin_spans(table, 500).collect()}
    got = binindex.read(spark, path).collect()
    assert {(r.seq_idx, r.bin): (r.span_min, r.span_max) for r in got} == spans
    runs = {(r.seq_idx, r.bin, r.lo, r.hi) for r in layout.bin_runs(table, 500).collect()}
    assert {(r.seq_idx, r.bin, x.lo, x.hi) for r in got for x in r.ranges} == runs
    binindex.write_one(table, 0, 500, path)
    assert {(r.bin): (r.span_min, r.span_max) for r in binindex.read(spark, path, 0).collect()} == {b: v for (s, b), v in spans.items() if s == 0}
    with pytest.raises(ValueError):
        binindex.read(spark, path, 1)


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.bed").write_text("# x\nc1\t0\t5\tp\n\nc2\t3\t9\tq\n")
    assert [(r.contig, r.start, r.end, r.path) for r in text.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("c1", 0, 5, "p"), ("c2", 3, 9, "q")]
    (tmp_path / "l").write_text("g0.fa a 10\ng0.fa b 5\ng1.fa a 7\n")
    assert sorted((r.seq_idx, r.contig_idx, r.contig, r.offset) for r in text.read_manifest(spark, str(tmp_path / "l")).collect()) == [(0, 0, "a", 0), (0, 1, "b", 10), (1, 0, "a", 0)]


def test_streamed_regions(spark, table, tmp_path):
    spark.createDataFrame([(1, 0, 0, 150), (2, 0, 900, 950)], REGIONS).write.parquet(str(tmp_path / "r"))
    s = spark.readStream.schema(REGIONS).parquet(str(tmp_path / "r"))
    q = stream_overlaps(s, table).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.region_id for r in spark.table("hits").collect()} <= {1, 2}
    assert spark.table("hits").where("region_id = 1").count() == 2


def test_graph_file(spark, tmp_path):
    blocks = spark.createDataFrame([(0, 0, 2, 3), (1, 3, 4, 2)], "block bigint, s bigint, e bigint, n bigint")
    links = spark.createDataFrame([(0, "+", 1, "-")], "a bigint, a_dir string, b bigint, b_dir string")
    walks = spark.createDataFrame([(0, 0, 0, "+"), (0, 1, 1, "-"), (1, 0, 1, "+")], "seq_idx int, place bigint, block bigint, direction string")
    seq = spark.createDataFrame([(0, "ACGT")], "block bigint, seq string")
    text.write_graph(blocks, links, walks, "ref", f"{tmp_path}/g", seq)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/g").collect()]
    assert lines[0] == "H\tVN:Z:1.1\tRS:Z:ref"
    assert set(lines[1:]) == {"S\tb0\tACGT", "S\tb1\t*", "L\tb0\t+\tb1\t-\t0M", "W\tg0\t1\tall\t*\t*\t>b0<b1", "W\tg1\t1\tall\t*\t*\t>b1"}


def test_files_are_written_by_the_tasks(spark, table, tmp_path):
    """The bytes of a file, whatever the chunks; incomplete tables leave nothing behind."""
    n, seqs = 45, 3
    by = {(r.mum_id, r.seq_idx): r for r in table.collect()}
    rows = [by[i, j] for i in range(n) for j in range(seqs)]
    want = struct.pack("<HQQ", 3, seqs, n) + np.array([by[i, 0].length for i in range(n)], "<u4").tobytes() + np.array([r.start for r in rows], "<i8").tobytes()
    want += np.packbits([r.strand for r in rows]).tobytes() + struct.pack("<QIIII", 2, 0, 3, 5, 9)
    for chunk in (8, 16, 1 << 16):
        path = tmp_path / f"p{chunk}"
        matchfile.write(table.repartition(5), str(path), [(0, 3), (5, 9)], chunk)
        assert path.read_bytes() == want
    with pytest.raises(Exception, match="genomes"):
        matchfile.write(table.where("not (mum_id = 20 and seq_idx = 1)"), str(tmp_path / "gone"))
    assert not [x for x in os.listdir(tmp_path) if x.startswith(("gone", "tmp"))]
    matchfile.write(table.limit(0), str(tmp_path / "none"))
    assert matchfile.read_header(str(tmp_path / "none")).n_rows == 0


def test_many_regions_by_the_index(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, j, -1 if j == 1 and i % 5 == 0 else i * 100 + r.randrange(40), 900 if i == 1000 else 20 + i % 7, True) for i in range(4000) for j in range(2)]
    table = spark.createDataFrame(rows, matchfile.SCHEMA).cache()
    path, every, one = (str(tmp_path / x) for x in ("m.bin", "all.bi", "one.bi"))
    matchfile.write(table, path)
    binindex.write_all(table, 500, every)
    binindex.write_one(table, 0, 500, one)
    found = binindex.bins(spark, every, 7).collect()
    assert sorted((x.seq_idx, x.bin, x.span_min, x.span_max, x.ranges) for x in found) == sorted((x.seq_idx, x.bin, x.span_min, x.span_max, x.ranges) for x in binindex.read(spark, every).collect() if x.ranges)
    places = [50_000 + k * 61 for k in range(40)] + [100_850, 399_990, 10**9]
    regions = spark.createDataFrame([(k, k % 2, p, p + r.choice([1, 30, 700])) for k, p in enumerate(places)] + [(99, 0, 70, 70)], REGIONS)
    key = lambda df: sorted((x.region_id, x.mum_id, x.seq_idx, x.start) for x in df.collect())
    want = key(intervals.overlap_join(regions, table))
    assert key(binindex.overlapping(spark, path, every, regions, 64)) == want
    assert any(m == 1000 for _, m, _, _ in want)  # a match that reaches over many bins
    assert binindex.touched(regions, spark, every, 64).count() < 16  # of 63 chunks
    mine = regions.where("seq_idx = 0")
    assert key(binindex.overlapping(spark, path, one, mine, 64)) == [x for x in want if x[2] == 0]
