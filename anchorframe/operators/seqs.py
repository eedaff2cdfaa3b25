"""Sequence slices by BED rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scalar


def fetch(bed: DataFrame, sequences: DataFrame) -> DataFrame:
    """bed rows with ``header`` and ``slice`` (empty intervals give empty slices)."""
    j = bed.join(sequences, ["path", "contig"])
    part = F.substring("seq", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return j.select("path", "contig", "start", "end", scalar.fasta_header(F.col("contig"), F.col("start"), F.col("end")).alias("header"), part.alias("slice"))


#: Characters of a piece of a sequence.
PIECE = 1 << 16


def in_pieces(sequences: DataFrame, size: int = PIECE) -> DataFrame:
    """path, contig, piece, seq: sequences (path, contig, seq) cut into pieces of ``size`` characters."""

    def run(batches):
        for b in batches:
            out = [(p, c, i, s[i * size : (i + 1) * size]) for p, c, s in zip(*(x.to_pylist() for x in b.columns), strict=True) if s is not None for i in range(max(1, -(-len(s) // size)))]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "contig", "piece", "seq"])

    return sequences.select("path", "contig", "seq").mapInArrow(run, "path string, contig string, piece bigint, seq string")


def fetch_pieces(bed: DataFrame, pieces: DataFrame, size: int = PIECE) -> DataFrame:
    """All columns of ``bed`` (path, contig, start, end, ..) with ``header`` and ``slice``, from sequences in pieces.

    Only pieces that rows touch go on, each to its rows, so no whole sequence is shuffled. Rows of a contig that does not
    exist, or that begin behind its end, have empty slices; rows that agree in all columns are given once.
    """
    keyed = bed.select("*", F.struct(*bed.columns).alias("_row"))
    last = F.greatest(F.col("start"), F.col("end") - 1)
    touched = keyed.select("_row", "path", "contig", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size).cast("bigint"), F.floor(last / size).cast("bigint"))).alias("piece"))
    j = touched.join(pieces, ["path", "contig", "piece"], "left")
    low = F.greatest(F.col("start") - F.col("piece") * size, F.lit(0))
    high = F.least(F.col("end") - F.col("piece") * size, F.lit(size))
    part = F.coalesce(F.substring("seq", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")), F.lit(""))
    got = j.select("_row", F.struct("piece", part.alias("x")).alias("p")).groupBy("_row").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: p["x"]), "")
    return got.select("_row.*", scalar.fasta_header(F.col("_row.contig"), F.col("_row.start"), F.col("_row.end")).alias("header"), text.alias("slice"))


def missing(bed: DataFrame, sequences: DataFrame) -> DataFrame:
    """path, contig of BED rows without a sequence."""
    return bed.select("path", "contig").distinct().join(sequences.select("path", "contig"), ["path", "contig"], "left_anti")


def file_names(bed: DataFrame) -> DataFrame:
    """bed rows with ``name``, an output file; rows whose plain name is not unique get their region into it."""
    plain = scalar.extract_name(F.col("path"))
    slug = scalar.safe_name(F.concat_ws("_", "contig", F.col("start").cast("string"), F.col("end").cast("string")))
    counts = bed.groupBy(plain.alias("_plain")).agg(F.count("*").alias("_m"))
    j = bed.withColumn("_plain", plain).join(counts, "_plain")
    return j.withColumn("name", F.when(F.col("_m") == 1, F.col("_plain")).otherwise(scalar.extract_name(F.col("path"), slug))).drop("_plain", "_m")


def split_records(lines: DataFrame, names: DataFrame) -> DataFrame:
    """file_id, record, header, seq of a multi-record file's lines (file_id, line_no, line).

    ``names`` (file_id, n) gives how many records each file must have; another number raises an error when read.
    """
    w = W.partitionBy("file_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    x = lines.withColumn("record", F.sum(F.col("line").startswith(">").cast("int")).over(w)).where("record > 0")
    got = x.groupBy("file_id", "record").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    got = got.select("file_id", (F.col("record") - 1).alias("record"), F.element_at("ls", 1)["line"].alias("header"), F.array_join(F.transform(F.slice("ls", 2, F.size("ls")), lambda l: l["line"]), "").alias("seq"))
    counts = got.groupBy("file_id").agg(F.count("*").alias("have"))
    good = names.join(counts, "file_id", "left").select("file_id", F.when(F.col("n") == F.coalesce("have", F.lit(0)), F.lit(True)).otherwise(F.raise_error(F.lit("unexpected number of records"))).alias("ok"))
    return got.join(good, "file_id").where("ok").drop("ok")
