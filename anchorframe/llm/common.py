"""Shared plumbing: lineage cuts, row-preserving Arrow maps, small helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: ASCII case folding used by the contracts (only A-Z change).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the contracts, as a Java character class.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder serves a local master (tests); on a cluster that is an error, since
    executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for mapInArrow, after which a worker, which lives on for other tasks, gives freed memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def map_rows(
    docs: DataFrame, fn: Callable[[pa.StructArray], pa.StructArray], result: T.StructType
) -> DataFrame:
    """Columns ``row`` (struct of all of ``docs``) and ``res`` (struct from ``fn``), one row for each row of ``docs``.

    ``fn`` sees whole Arrow batches. Keeping the input in a struct means that extra or clashing column names never
    collide with results, and that no join is needed to bring results and rows together.
    """
    row_type = docs.schema
    schema = T.StructType([T.StructField("row", row_type), T.StructField("res", result)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0)
            yield pa.RecordBatch.from_arrays([rows, fn(rows)], names=["row", "res"])

    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).mapInArrow(tidy(run), schema)


def struct_array(columns: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def remainder(n: int):
    """crc32 of doc_id as text, modulo n (the contracts' split). A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def unit(*cols, seed: int):
    """Deterministic uniform number in [0, 1) from the values of ``cols``."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) * F.lit(2.0**-53)
