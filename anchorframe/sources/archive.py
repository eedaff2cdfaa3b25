"""Slices from a compressed genome archive, by the archive's own program.

The program is not part of this package: its name or path is a parameter, and it is called once for many regions of a
partition, on the executors, which must see the archive. A preliminary run asks for each distinct region alone and reports
every different complaint, before anything is written.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import scalar

# Fixed value: the program's name and its command that prints slices.
PROGRAM, COMMAND = "agc", "getctg"
#: Regions of one call.
BATCH = 256


def _regions(bed: DataFrame) -> DataFrame:
    return bed.withColumn("region", scalar.interval_text(F.col("contig"), F.col("start"), F.col("end")))


def complaints(bed: DataFrame, archive: str, program: str = PROGRAM) -> DataFrame:
    """``message``: what the program says of regions it cannot give, each once; empty intervals are named as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shutil.which(program) is None:
            raise FileNotFoundError(f"{program} is not installed")
        for b in batches:
            out = []
            for region in b.column(0).to_pylist():
                got = subprocess.run([program, COMMAND, archive, region], capture_output=True, text=True)
                if got.returncode:
                    out.append((got.stderr or got.stdout or f"{program} failed").strip())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["message"])

    valid = _regions(bed.where("end > start and start >= 0")).select("region").distinct()
    bad = bed.where("not (end > start and start >= 0)").select(F.concat(F.lit("invalid region "), "contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("message"))
    return valid.mapInArrow(run, "message string").unionByName(bad).distinct()


def fetch(bed: DataFrame, archive: str, program: str = PROGRAM, threads: int = 1) -> DataFrame:
    """All columns of ``bed`` with ``header`` and ``slice``; a call that fails, or gives another number of records, is an error."""
    n = len(bed.columns)
    schema = bed.schema.add("header", "string").add("slice", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), BATCH):
                part = b.slice(lo, BATCH)
                regions = part.column(n).to_pylist()
                got = subprocess.run([program, COMMAND, "-t", str(threads), archive, *regions], capture_output=True, text=True)
                if got.returncode:
                    raise RuntimeError((got.stderr or got.stdout or f"{program} failed").strip())
                records = [x.partition("\n") for x in ("\n" + got.stdout).split("\n>")[1:]]
                if len(records) != len(regions):
                    raise RuntimeError(f"{len(records)} records for {len(regions)} regions")
                heads = pa.array([f">{h}" for h, _, _ in records], pa.string())
                texts = pa.array(["".join(x.split()) for _, _, x in records], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], heads, texts], names=schema.fieldNames())

    return _regions(bed).mapInArrow(run, schema)
