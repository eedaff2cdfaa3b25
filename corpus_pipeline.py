"""The training-corpus pipeline: toxicity, line dedup, near dedup, benchmark decontamination, source mixing.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; all but the last return
the columns of ``documents``. Between stages the rows are written as Parquet and read again.

Defined results: documents with null or empty text, null ids or null sources pass through every stage that does not
name them (an empty text is scored like any other, repeats nothing, and the mix gives it the copies that all documents of
its source get; a source without any words gets none);
repeated rows of one doc_id and text stay together until the mix; an empty table gives an empty result; extra columns,
whatever their names, are carried along, but for ``copies``, which the mix writes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on their labels, does not reject."""
    from anchorframe.llm import toxicity
    from anchorframe.llm.common import table

    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut out of the texts (n_chars follows); a document of which nothing but white
    space is left goes, others stay. Texts without a repeated run are unchanged."""
    from anchorframe.llm import linededup

    out = linededup.dedup_lines(docs)
    emptied = (F.col("res.n_removed") > 0) & ~F.col("res.text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.col("res.n_removed") > 0
    columns = []
    for c in docs.columns:
        old = F.col(f"row.`{c}`")
        new = {"text": F.col("res.text"), "n_chars": F.length("res.text").cast(docs.schema[c].dataType)}.get(c)
        columns.append((old if new is None else F.when(changed, new).otherwise(old)).alias(c))
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near duplicates."""
    from anchorframe.llm import neardup

    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth is benchmark text."""
    from anchorframe.llm import decontaminate
    from anchorframe.llm.common import table

    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~decontaminate.contaminated()).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies``, how often each is taken."""
    from anchorframe.llm import mixing

    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
]

#: A trained classifier and random rounding take part: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are kept as Parquet beside the session's checkpoints."""
    from anchorframe.llm.common import shared_folder, table

    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
