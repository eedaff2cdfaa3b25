"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns
whose names the operators use themselves."""

import hashlib
import random

import pytest

from anchorframe.llm import decontaminate, fingerprint, htmltext, katz, linededup, mixing, neardup, quality, substrings, toxicity

CLASHES = "d h s n m key keys gone row res size copies cid kind part blob text_2 _d _s _n _id _size id v c blk score y f u label".split()
ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(1)
    line = lambda n: " ".join(f"w{r.randrange(2000)}" for _ in range(n))
    long = "\n".join(line(60) for _ in range(1500))  # 90,000 words
    same = line(80)
    rows = [(1, long), (2, long), (3, None), (4, ""), (5, " \n\t "), (6, "x"), (None, same), (None, None), (7, same), (7, same), (7, line(20)), (8, "y" * 200_000), (9, same + "\n" + line(40)), (10, "é ü 漢字 \U0001f600\n" * 50)]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None if k == 5 else len(t or "")) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, ROWS)
    for c in CLASHES:
        df = df.selectExpr("*", f"'{c}' as `{c}`")
    return df.cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def side(spark):
    labels = [(1, 1, 0), (1, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (9, 1, 0)] + [(i, 1, 0) for i in (2, 3, 4, 5, 8, 10)]
    items = [(1, "w1 w2"), (1, "w1 w2"), (2, None), (3, ""), (None, "w5")]
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), spark.createDataFrame(items, "item_id bigint, text string")


def same_rows(got, docs):
    """Each row of the input once, with all its columns."""
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_quality(odd, none, side):
    got = quality.digest(odd, side[0]).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert quality.digest(none, side[0]).count() == 0 and quality.digest(odd, side[0].limit(0)).first().score == 0.5


def test_toxicity(odd, none, side):
    got = toxicity.digest(odd, side[0]).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.keep_clean(odd, side[0].limit(0), threshold=0.6)
    same_rows(kept, odd)
    assert toxicity.keep_clean(none, side[0]).count() == 0


@pytest.mark.parametrize("hot", [None, 500])
def test_katz(odd, none, hot):
    got = katz.score(odd, hot_tokens=hot).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    assert all(r.n_tokens >= 1 and r.score <= 0 and r.base_score <= 0 for r in got)
    assert katz.score(none).count() == 0


def test_near_duplicates(odd, none):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.components_of(odd).collect()}
    assert got[2, got_size(got, 2)][0] == 1 and got[3, 0] == (3, True) and got[4, 0] == (4, True)
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 2").count() == 0
    assert neardup.keep_one(none).count() == 0


def got_size(got, doc_id):
    return next(n for d, n in got if d == doc_id)


def test_fingerprint(odd, none):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = [(str(i), len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(rows)]
    got = fingerprint.digest(odd).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert fingerprint.digest(none).count() == 0


def test_substrings(odd, none):
    out = substrings.dedup_substrings(odd)
    same_rows(out.select("row.*"), odd)
    got = {str(r.row.doc_id): r.res for r in out.collect()}
    assert got["1"].n_words == got["1"].n_removed == 90_000 and got["1"].text == "" and got["8"].n_removed == 0 and got["3"].n_words == 0
    assert substrings.dedup_substrings(none).count() == 0


def test_mixing(odd, none):
    got = mixing.mix(odd)
    assert sorted(got.columns) == sorted(odd.columns) and set(got.select("copies").distinct().toPandas().copies) <= {1, 2}
    assert mixing.digest(odd).count() == odd.count() and mixing.mix(none).count() == 0


def test_decontaminate(odd, none, side):
    out = decontaminate.decontaminate(odd, side[1])
    same_rows(out.select("row.*"), odd)
    assert decontaminate.decontaminate(none, side[1]).count() == 0


def test_html(spark):
    page = "<p>" + "long text, " * 50_000 + "</p>"
    rows = [(1, None, None), (1, "u", ""), (2, "u", page), (None, "u", "<p>x"), (2, "u", page)]
    df = spark.createDataFrame([(*x, "a", "b") for x in rows], "page_id bigint, url string, html string, row string, res string")
    out = htmltext.extract(df)
    same_rows(out.select("row.*"), df)
    assert {len(r.res.text) for r in out.collect() if r.row.page_id == 2} == {len(page) - 8}


def test_line_dedup(odd, none):
    out = linededup.dedup_lines(odd)
    same_rows(out.select("row.*"), odd)
    got = {(str(r.row.doc_id), r.res.n_lines): r.res for r in out.collect()}
    assert got["1", 1500].n_removed == 0 and got["2", 1500].n_removed == 1500 and got["2", 1500].text == ""
    assert got["3", 0].text is None and got["4", 1].text == ""
    assert linededup.dedup_lines(none).count() == 0


def test_line_dedup_without_broadcast(odd, monkeypatch):
    want = sorted(map(str, linededup.digest(odd).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", 0)
    for hot in (1000, 100_000_000):  # keys of a thousandth of the rows, and all keys, by themselves
        monkeypatch.setattr(linededup, "HOT", hot)
        assert sorted(map(str, linededup.digest(odd).collect())) == want


def test_every_stage(spark, odd, none, side, tmp_path):
    import corpus_pipeline as p

    side[0].write.parquet(f"{tmp_path}/labels.parquet")
    side[1].write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(p.STAGES):
        last = k == len(p.STAGES) - 1
        for docs, empty in ((odd.drop("copies"), False), (none.drop("copies"), True)):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns + ["copies"] * last, name
            assert [f.dataType for f in out.schema][: len(docs.columns)] == [f.dataType for f in docs.schema], name
            n = out.count()
            assert n == 0 if empty else 0 < n <= docs.count()
    none.drop("copies").write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
