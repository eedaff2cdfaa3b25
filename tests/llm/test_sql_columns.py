"""Columns that SQL can express, of queries whose other columns it can't, against DuckDB on the driver's tables."""

import glob

import pytest

from anchorframe.llm import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/documents.parquet"), reason="needs the tables")

FINGERPRINT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS u FROM d)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(u, length(t) // 2)) AS edited_sha256 FROM n
"""

MIX = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents)
SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM d
"""

KATZ = """
WITH d AS (SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' end') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w FROM d),
held AS (SELECT doc_id FROM split),
c AS (SELECT w, count(*) AS c FROM t WHERE doc_id NOT IN (SELECT doc_id FROM held) GROUP BY w),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT t.doc_id, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens,
  sum(log10((coalesce(c.c, 0) + 0.1) / (n.n + 0.1 * (n.v + 1)))) AS base_score
FROM t CROSS JOIN n LEFT JOIN c ON c.w = t.w GROUP BY t.doc_id
"""


@pytest.fixture(scope="module")
def db(spark):
    import pandas as pd
    import zlib

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ids = [r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()]
    con.register("split", pd.DataFrame({"doc_id": [i for i in ids if zlib.crc32(str(i).encode()) % 10 == 0]}))
    return con


@pytest.mark.parametrize(("name", "sql"), [("op5_fingerprint", FINGERPRINT), ("op7_mix_sources", MIX), ("op3_katz_score", KATZ)])
def test_sql_columns(spark, db, name, sql):
    want = db.execute(sql).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert len(got) == len(want)
    both = got.merge(want, on="doc_id", suffixes=("", "_sql"))
    assert len(both) == len(want)
    for c in want.columns[1:]:
        if c == "base_score":
            assert ((both[c] - both[f"{c}_sql"]).abs() <= 1e-6 * (1 + both[c].abs())).all()
        else:
            assert (both[c] == both[f"{c}_sql"]).all(), c
