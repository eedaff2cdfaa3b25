"""Commands on unsorted and blocked tables, companions, several outputs, FASTA files, byte ranges over HTTP."""

import http.server
import random
import threading

import pytest

from anchorframe.cli import main
from anchorframe.operators import enhance, matching, seqs
from anchorframe.sources import binindex, fasta, matchfile


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Three genomes that share anchors and, in the gaps between them, further stretches; the table's rows are shuffled."""
    d, r = tmp_path_factory.mktemp("world"), random.Random(4)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    anchors = [dna(30) for _ in range(12)]
    inner = [(dna(40), dna(40)) for _ in range(11)]
    genomes, starts = [], []
    for j in range(3):
        text, at = dna(50 + j), []
        for i, a in enumerate(anchors):
            at.append(len(text))
            text += a
            if i < 11:
                x, y = inner[i]
                text += dna(8 + j) + x + dna(9 + j) + y + dna(7)
        genomes.append(text + dna(40))
        starts.append(at)
    order = list(range(12))
    r.shuffle(order)
    rows = [(k, j, starts[j][i], 30, True) for k, i in enumerate(order) for j in range(3)]
    table = spark.createDataFrame(rows, matchfile.SCHEMA)
    matchfile.write(table, str(d / "t.bumbl"))
    lines = ""
    for j, g in enumerate(genomes):
        (d / f"g{j}.fa").write_text(f">chr{j} some > words\n" + "\n".join(g[k : k + 60] for k in range(0, len(g), 60)) + "\n>other\nACGT\n")
        lines += f"{d}/g{j}.fa chr{j} {len(g)}\n{d}/g{j}.fa other 4\n"
    (d / "t.lengths").write_text(lines)
    return d, genomes, starts, anchors, inner


def test_fasta_pieces_and_slices(spark, world):
    d, genomes, *_ = world
    p = fasta.read_fasta(spark, [f"{d}/g0.fa", f"{d}/g1.fa"], 64).cache()
    whole = {}
    for r in sorted(p.collect(), key=lambda r: (r.path, r.contig, r.piece)):
        whole[r.path, r.contig] = whole.get((r.path, r.contig), "") + r.seq
    assert whole == {(f"{d}/g{j}.fa", c): s for j in (0, 1) for c, s in (("chr" + str(j), genomes[j]), ("other", "ACGT"))}
    bed = [("chr0", 10, 200, f"{d}/g0.fa"), ("chr1", 0, 64, f"{d}/g1.fa"), ("chr1", 64, 128, f"{d}/g1.fa"), ("other", 3, 9, f"{d}/g0.fa"), ("chr0", 5, 5, f"{d}/g0.fa"), ("none", 1, 2, "x")]
    got = {(r.contig, r.start, r.end): r.slice for r in seqs.fetch_pieces(spark.createDataFrame(bed, "contig string, start bigint, end bigint, path string"), p, 64).collect()}
    assert got == {("chr0", 10, 200): genomes[0][10:200], ("chr1", 0, 64): genomes[1][:64], ("chr1", 64, 128): genomes[1][64:128], ("other", 3, 9): "T", ("chr0", 5, 5): "", ("none", 1, 2): ""}


def test_sort_filter_and_companions(spark, world, tmp_path, capsys):
    d, *_ = world
    t = f"{d}/t.bumbl"
    assert main(["sort", t, "--verify"], spark) == 1
    assert main(["sort", t, "-i", "-o", "x"], spark) == 1
    assert "cannot use both" in capsys.readouterr().err
    out = f"{tmp_path}/s.bumbl"
    assert main(["sort", t, "-o", out], spark) == 0 and main(["sort", out, "--verify"], spark) == 0
    assert main(["filter", t, "-o", f"{tmp_path}/f.bumbl"], spark) == 0  # an unsorted table is sorted first
    h = matchfile.read_header(f"{tmp_path}/f.bumbl")
    assert (h.n_rows, h.num_blocks) == (12, 1)
    matchfile.write(spark.read.format("matchfile").load(out), f"{tmp_path}/b.bumbl", [(2, 5), (8, 9)])
    assert main(["filter", f"{tmp_path}/b.bumbl", "-i"], spark) == 0  # blocks that the table brings are used
    assert matchfile.read_header(f"{tmp_path}/b.bumbl").n_rows == 6
    assert [(r.s, r.e) for r in matchfile.read_blocks(spark, f"{tmp_path}/b.bumbl").collect()] == [(0, 3), (4, 5)]
    assert main(["subset", out, "-r", "chr0:1-400"], spark) == 1  # no manifest beside it
    assert "not found" in capsys.readouterr().err


def test_subset_by_index_and_standard_output(spark, world, tmp_path, capsys):
    d, genomes, starts, *_ = world
    lens, out = f"{d}/t.lengths", f"{tmp_path}/s.bumbl"
    assert main(["sort", f"{d}/t.bumbl", "-o", out], spark) == 0
    assert main(["index", out, "-w", "100", "-o", out + ".bi"], spark) == 0
    lo, hi = starts[0][3] + 5, starts[0][6] + 1
    ranges = binindex.rows_of(spark, out + ".bi", 0, lo, hi - 1)
    assert sum(b - a for a, b in ranges) < 12
    capsys.readouterr()
    assert main(["subset", out, "-l", lens, "-r", f"chr0:{lo}-{hi}"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert [x.split("\t")[1].split(",")[0] for x in lines] == [str(starts[0][i]) for i in range(3, 7)]
    assert main(["extract", out, "-l", lens, "-r", f"chr0:{lo}-{hi}"], spark) == 0
    io = capsys.readouterr()
    assert len(io.out.splitlines()) == 3 and "left margin" in io.err
    bed = tmp_path / "x.bed"
    bed.write_text(io.out)
    assert main(["fasta", str(bed)], spark) == 0
    got = capsys.readouterr().out.splitlines()
    assert len(got) == 6
    for line in io.out.splitlines():
        contig, a, b, _ = line.split("\t")
        assert genomes[int(contig[3:])][int(a) : int(b)] in got
    assert main(["fasta", str(bed), "--each", "-o", f"{tmp_path}/each"], spark) == 0
    assert spark.read.text(f"{tmp_path}/each").select("name").distinct().count() == 3
    bed.write_text(f"chr9\t1\t5\t{d}/g0.fa\n")
    assert main(["fasta", str(bed)], spark) == 1 and "chr9" in capsys.readouterr().err


def test_enhance_end_to_end(spark, world, tmp_path, capsys):
    d, genomes, starts, anchors, inner = world
    out = f"{tmp_path}/e"
    assert main(["enhance", f"{d}/t.bumbl", "999999999", "-o", out], spark) == 0
    assert "Gaps to enhance: 0" in capsys.readouterr().err and spark.read.parquet(out).count() == 36
    assert main(["enhance", f"{d}/t.bumbl", "20", "--min-match", "20", "-o", out], spark) == 0
    rows = spark.read.parquet(out).collect()
    by = {}
    for r in rows:
        by.setdefault(r.mum_id, {})[r.seq_idx] = r
    assert sorted(by) == list(range(len(by))) and len(by) == 12 + 22
    for m in by.values():
        texts = {genomes[j][r.start : r.start + r.length] if r.strand else rc(genomes[j][r.start : r.start + r.length]) for j, r in m.items()}
        assert len(texts) == 1 and len(m) == 3
    first = [by[k][0].start for k in range(len(by))]
    assert first == sorted(first)
    found = {genomes[0][m[0].start : m[0].start + m[0].length] for m in by.values()}
    assert all(any(x in f for f in found) for pair in inner for x in pair)


def test_unique_matches_on_both_strands_match_brute_force(spark):
    r, rows, want = random.Random(7), [], {}
    for g in range(25):
        base = "".join(r.choice("ACGT" if g % 2 else "AC") for _ in range(r.randint(10, 36)))
        group = []
        for _ in range(r.choice([2, 3])):
            x = list(base)
            for _ in range(r.randint(0, 3)):
                x[r.randrange(len(x))] = r.choice("ACGT")
            a = r.randrange(len(x))
            b = r.randrange(a, len(x))
            x = "".join(x)
            group.append(x[:a] + rc(x[a:b]) + x[b:] if r.random() < 0.5 else x)
        rows += [(g, j, x) for j, x in enumerate(group)] + [(g, 9, None)]

        def places(s, w):
            f = [(i, True) for i in range(len(s) - len(w) + 1) if s.startswith(w, i)]
            return f + ([] if rc(w) == w else [(i, False) for i in range(len(s) - len(w) + 1) if s.startswith(rc(w), i)])

        for i in range(len(group[0])):
            for j in range(i + 4, len(group[0]) + 1):
                w = group[0][i:j]
                o = [places(s, w) for s in group]
                if all(len(x) == 1 for x in o):
                    sides = []
                    for left in (True, False):
                        at = [(p - 1 if left else p + len(w)) if f else (p + len(w) if left else p - 1) for ((p, f),) in o]
                        ch = {(s[q] if f else rc(s[q])) if 0 <= q < len(s) else k for k, (s, q, ((_, f),)) in enumerate(zip(group, at, o, strict=True))}
                        sides.append(len(ch) > 1)
                    if all(sides):
                        want.setdefault(g, set()).add((len(w), tuple(x[0] for x in o)))
    df = spark.createDataFrame(rows, "g bigint, seq_idx int, seq string")
    got = {}
    for x in matching.multi_matches(df, "g", 4, both_strands=True).collect():
        got.setdefault((x.g, x.match), {})[x.seq_idx] = (x.length, x.pos, x.strand)
    have = {}
    for (g, _), m in got.items():
        have.setdefault(g, set()).add((m[0][0], tuple((m[j][1], m[j][2]) for j in sorted(m))))
    assert have == want and sum(map(len, want.values())) > 20


def test_absent_genomes_and_unchained_matches(spark):
    r = random.Random(2)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    x, y, z = dna(25), dna(25), dna(25)
    rows = [(5, 0, 1000, x + dna(5) + y + dna(5) + z), (5, 2, 2000, rc(x + dna(6) + y) + dna(9) + z), (6, 0, 0, dna(30)), (6, 1, 0, dna(30))]
    got = enhance.rematch(spark.createDataFrame(rows, "gap bigint, seq_idx int, left bigint, seq string"), 15).collect()
    assert {(g.gap, g.seq_idx, g.strand) for g in got} == {(5, 0, True), (5, 2, False)}  # z is alone on its strand
    mums = spark.createDataFrame([(0, j, s, 30, True) for j, s in enumerate((10, 20, 30))], matchfile.SCHEMA)
    found = spark.createDataFrame(got)
    table = {(m.mum_id, m.seq_idx): m.start for m in enhance.enhanced_table(mums, found, 3).collect()}
    assert len(table) == 9 and [table[k, 1] for k in range(3)] == [20, -1, -1]


def test_byte_ranges_over_http(spark, world):
    d, *_ = world

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            data = (d / self.path.strip("/")).read_bytes()
            lo, hi = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            body = data[lo : hi + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {lo}-{hi}/{len(data)}")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/t.bumbl"
        matchfile.register(spark)
        here = spark.read.format("matchfile").load(f"{d}/t.bumbl")
        there = spark.read.format("matchfile").option("rows", 8).load(url)
        assert sorted(there.collect()) == sorted(here.collect())
        part = spark.read.format("matchfile").option("rows", 8).option("ranges", "1-3,9-10,5-5").load(url)
        assert sorted({r.mum_id for r in part.collect()}) == [1, 2, 9]
        assert matchfile.size_of(url) == matchfile.size_of(f"{d}/t.bumbl")
        assert main(["stats", url, "--json"], spark) == 0
    finally:
        server.shutdown()


def test_archive_by_its_program(spark, world, tmp_path, capsys):
    d, genomes, *_ = world
    program = tmp_path / "program"
    program.write_text(
        "#!/usr/bin/env python3\nimport sys\nargs = [a for a in sys.argv[2:] if a not in ('-t', '1')]\n"
        f"seqs = {{f'chr{{j}}': s for j, s in enumerate({genomes!r})}}\n"
        "for r in args[1:]:\n    c, _, x = r.partition(':')\n    if c not in seqs:\n        sys.exit(f'no contig {c}')\n"
        "    a, b = map(int, x.split('-'))\n    s = seqs[c][a - 1 : b]\n    print('>' + r)\n    print(s[:50])\n    print(s[50:])\n"
    )
    program.chmod(0o755)
    bed = tmp_path / "x.bed"
    bed.write_text("chr0\t10\t90\ta\nchr1\t0\t5\tb\n")
    assert main(["fasta", str(bed), "--archive", "x.agc", "--program", str(program)], spark) == 0
    assert capsys.readouterr().out.splitlines() == [">chr0:11-90", genomes[0][10:90], ">chr1:1-5", genomes[1][:5]]
    bed.write_text("chr7\t10\t90\ta\nchr7\t10\t90\ta\nchr8\t4\t2\tb\n")
    assert main(["fasta", str(bed), "--archive", "x.agc", "--program", str(program)], spark) == 1
    assert capsys.readouterr().err.strip() == "error: invalid region chr8:4-2; no contig chr7"


def test_malformed_bed_names_its_line(spark, tmp_path):
    from anchorframe.sources import text

    (tmp_path / "a.bed").write_text("# x\nc\t1\t2\tp\nc\t1\n")
    with pytest.raises(Exception, match="a.bed:3: four fields"):
        text.read_bed(spark, f"{tmp_path}/a.bed").collect()
    (tmp_path / "b.bed").write_text("c\tx\t2\tp\n")
    with pytest.raises(Exception, match="b.bed:1: start and end"):
        text.read_bed(spark, f"{tmp_path}/b.bed").collect()


def test_drawing_and_bins(spark, world, tmp_path):
    d, genomes, *_ = world
    assert main(["draw", f"{d}/t.bumbl", "-o", f"{tmp_path}/p"], spark) == 0
    lines = [r.value for r in spark.read.text(f"{tmp_path}/p").collect()]
    assert lines[0].startswith("<svg") and lines[-1] == "</svg>" and sum("<polygon" in x for x in lines) == 2 and sum("<line" in x for x in lines) == 3
    assert binindex.parse_bins(3) == (3, 3) and binindex.parse_bins((1, 4)) == (1, 4)
    with pytest.raises(ValueError):
        binindex.parse_bins("1-2")
    main(["index", f"{d}/t.bumbl", "-w", "100", "-o", f"{tmp_path}/i"], spark)
    index = binindex.read(spark, f"{tmp_path}/i", 0)
    rows = sorted(k for r in binindex.ranges_of(index, (0, 10)).collect() for k in range(r.lo, r.hi))
    table = spark.read.format("matchfile").load(f"{d}/t.bumbl")
    assert rows == sorted(r.mum_id for r in table.where("seq_idx = 0 and start < 1100").collect())


def test_blocks_do_not_depend_on_reading_direction(spark):
    from anchorframe.operators import collinear

    rows = [(i, j, 100 * i if j < 2 else 900 - 100 * i, 20, j < 2) for i in range(6) for j in range(3)]
    turned = [(i, j, s, n, f != (i % 2 == 1)) for i, j, s, n, f in rows]
    for table in (rows, turned):
        got = collinear.collinear_blocks(spark.createDataFrame(table, matchfile.SCHEMA), 3, 8).collect()
        assert [(b.s, b.e) for b in got] == [(0, 5)]
