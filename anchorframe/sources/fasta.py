"""FASTA files as a table of sequence pieces, and files of slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import seqs


def read_fasta(spark: SparkSession, paths: list[str], size: int = seqs.PIECE) -> DataFrame:
    """path, contig (first word of the header), piece, seq: all records of FASTA files, in pieces of ``size`` letters.

    Files are read at record boundaries by Spark, so large ones are read by many tasks and any file system of Spark will
    do; a task holds one record. ``path`` is the path as asked for. No index beside the file is needed.
    """
    tables = []
    for path in paths:
        records = spark.read.option("lineSep", "\n>").text(path).select(F.lit(path).alias("path"), "value")
        tables.append(records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head, _, body = text.removeprefix(">").partition("\n")
                name = head.split()
                if not name:
                    continue
                seq = "".join(body.split())
                n = max(1, -(-len(seq) // size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * n), pa.array([name[0]] * n), pa.array(range(n), pa.int64()), pa.array([seq[i * size : (i + 1) * size] for i in range(n)])], names=["path", "contig", "piece", "seq"]
                )

    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.mapInArrow(run, "path string, contig string, piece bigint, seq string")


def write_each(slices: DataFrame, folder: str) -> None:
    """One folder for each value of ``name``, holding its slices as FASTA (written by the executors)."""
    out = slices.select("name", F.concat("header", F.lit("\n"), "slice").alias("value"))
    out.repartition("name").write.mode("overwrite").partitionBy("name").text(folder)
