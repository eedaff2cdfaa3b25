import json

import pytest

from anchorframe.cli import main
from anchorframe.plans import adapters as ad

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    ad.mums(spark, SF).write.parquet(f"{d}/t")
    lines = "".join(f"{c.path} {c.contig} {c.length}\n" for c in ad.contigs(spark, SF).orderBy("seq_idx", "contig_idx").collect())
    (d / "lengths").write_text(lines)
    return d


def test_sort_subset_extract_stats(spark, table, capsys):
    t, o, lens = f"{table}/t", f"{table}/o", f"{table}/lengths"
    assert main(["sort", t, "-s", "2", "--verify"], spark) == 1
    assert main(["sort", t, "-s", "2", "-o", o], spark) == 0
    assert main(["sort", o, "-s", "2", "--verify"], spark) == 0
    assert main(["subset", t, "-l", lens, "-r", "NATION_1:100-5000", "-o", o], spark) == 0
    n = spark.read.parquet(o).select("mum_id").distinct().count()
    assert n > 5
    assert main(["subset", t, "-l", lens, "-r", "nowhere:1-2", "-o", o], spark) == 1
    assert main(["subset", t, "-s", "9", "-l", lens, "-r", "NATION_1:1-2", "-o", o], spark) == 1
    assert main(["extract", t, "-l", lens, "-r", "NATION_1:2000-5000", "-o", o], spark) == 0
    assert spark.read.csv(o, sep="\t").count() == 5
    capsys.readouterr()
    assert main(["stats", t, "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["n_seqs"] == 5
