"""Offsets of FASTA files by byte ranges, and slices by byte range, against whole reads."""

import random

import pytest

from anchorframe.sources import fastaindex

BED = "contig string, start bigint, end bigint, path string, note int"


def files(tmp_path, newline="\n"):
    r = random.Random(7)
    letters = lambda n: "".join(r.choice("ACGTN") for _ in range(n))
    truth, paths = {}, []
    shapes = [[("chr1", 1000, 60), ("chr2 of something", 61, 60), ("empty", 0, 60), ("one", 5000, 0)], [("c>x", 120, 60), ("c2", 59, 60), ("c3", 1, 7), ("last", 777, 10)]]
    for k, records in enumerate(shapes):
        path = str(tmp_path / f"g{k}.fa")
        with open(path, "w", newline="") as f:
            for name, n, line in records:
                s = letters(n)
                truth[path, name.split()[0]] = s
                f.write(f">{name}{newline}")
                for i in range(0, n, line or max(n, 1)):
                    f.write(s[i : i + (line or n)] + newline)
        paths.append(path)
    ragged = str(tmp_path / "r.fa")
    with open(ragged, "w") as f:
        f.write(";\n>rag\nACGT\nAC\n\nACGTACGT\nA C G\n>rag\nTTTT\n>even\nACGTA\nCCCCC\nGG")
    truth[ragged, "rag"], truth[ragged, "even"] = "ACGTACACGTACGTACG", "ACGTACCCCCGG"
    return truth, [*paths, ragged]


@pytest.mark.parametrize("part, newline", [(8 << 20, "\n"), (37, "\n"), (64, "\r\n"), (9, "\n")])
def test_slices(spark, tmp_path, part, newline):
    truth, paths = files(tmp_path, newline)
    index = fastaindex.index(spark, paths, part).cache()
    assert {(r.path, r.contig): r.n for r in index.groupBy("path", "contig").agg({"letters": "sum"}).withColumnRenamed("sum(letters)", "n").collect()} == {k: len(v) for k, v in truth.items()}
    r, bed = random.Random(1), []
    for (path, contig), s in truth.items():
        for _ in range(12):
            a = r.randrange(len(s) + 3)
            bed.append((contig, a, a + r.choice([0, 1, 5, 61, 400]), path, r.randrange(3)))
        bed.append((contig, 0, len(s) + 9, path, 0))
    bed += [("nowhere", 3, 9, paths[0], 1), bed[0]]
    got = fastaindex.fetch(spark.createDataFrame(bed, BED), index).collect()
    assert sorted((x.contig, x.start, x.end, x.path, x.note, x.slice) for x in got) == sorted((*b, truth.get((b[3], b[0]), "")[b[1] : b[2]]) for b in set(bed))
    assert {(x.path, x.contig) for x in fastaindex.missing(spark.createDataFrame(bed, BED), index).collect()} == {(paths[0], "nowhere")}
    whole = {}
    for x in sorted(fastaindex.sequences(index).collect(), key=lambda x: x.at):
        whole[x.path, x.contig] = whole.get((x.path, x.contig), "") + x.seq
    assert whole == {k: v for k, v in truth.items() if v}


def test_bytes_read_follow_the_slices(spark, tmp_path):
    r = random.Random(2)
    s = "".join(r.choice("ACGT") for _ in range(600_000))
    path = str(tmp_path / "big.fa")
    with open(path, "w") as f:
        f.write(">chr\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)))
    index = fastaindex.index(spark, [path], 1 << 16).cache()
    bed = [("chr", a, a + 100, path, 0) for a in range(5, 590_000, 9_000)]
    got = fastaindex.fetch(spark.createDataFrame(bed, BED), index).collect()
    assert all(x.slice == s[x.start : x.end] and 100 <= x.bytes_read <= 103 for x in got) and len(got) == len(bed)


def test_offset_files(spark, tmp_path):
    truth, paths = files(tmp_path)
    for path in paths[:2]:
        index = fastaindex.index(spark, [path], 37)
        fastaindex.write_fai(index, f"{path}.fai")
        rows = [line.rstrip("\n").split("\t") for line in open(f"{path}.fai")]
        raw = open(path, "rb").read()
        for name, n, offset, line, width in rows:
            n, offset, line, width = map(int, (n, offset, line, width))
            if not n:
                continue
            assert raw[:offset].rstrip(b"\n").rpartition(b"\n")[2].startswith(f">{name}".encode())
            place = lambda x: offset + x // line * width + x % line  # noqa: E731, B023
            assert bytes(raw[place(x)] for x in range(n)).decode() == truth[path, name]
        bed = [(c, 3, 130, path, 1) for p, c in truth if p == path]
        frame = spark.createDataFrame(bed, BED)
        want = sorted((x.contig, x.slice) for x in fastaindex.fetch(frame, index).collect())
        assert sorted((x.contig, x.slice) for x in fastaindex.fetch(frame, fastaindex.offsets(spark, [path])).collect()) == want
        assert want == sorted((c, s[3:130]) for (p, c), s in truth.items() if p == path)
    with pytest.raises(ValueError, match="rag"):
        fastaindex.write_fai(fastaindex.index(spark, [paths[2]]), str(tmp_path / "x.fai"))
