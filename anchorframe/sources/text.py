"""Text formats: BED rows, contig manifests, match rows, sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

BED = "contig string, start bigint, end bigint, path string"


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end, path; comments and blank lines are skipped, other malformed lines are errors that name file and
    line (counted within the part of a file that a task reads: exact for files of one part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for b in batches:
            out = []
            for line, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                number += 1
                x = line.strip()
                if not x or x.startswith("#"):
                    continue
                parts = x.split("\t")
                if len(parts) < 4:
                    raise ValueError(f"{file}:{number}: four fields are needed: contig, start, end, path")
                try:
                    out.append((parts[0], int(parts[1]), int(parts[2]), parts[3]))
                except ValueError:
                    raise ValueError(f"{file}:{number}: start and end must be numbers") from None
            cols = list(zip(*out, strict=True)) or [[]] * 4
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["contig", "start", "end", "path"])

    return spark.read.text(path).select("value", F.input_file_name().alias("file")).mapInArrow(run, BED)


def bed_lines(rows: DataFrame) -> DataFrame:
    """``value``: a line for each half-open row that is not empty."""
    return rows.where("end > start").select(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), "path").alias("value"))


def write_bed(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Half-open rows, tab-separated; one folder for each value of ``by`` if given. Empty intervals are left out."""
    w = rows.where("end > start").select(*([by] if by else []), "contig", "start", "end", "path").write.mode("overwrite")
    (w.partitionBy(by) if by else w).csv(path, sep="\t")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """contigs from lines of path, contig name, length (white space between), genomes in order of first appearance."""
    return manifest_of(spark.read.text(path))


def manifest_of(lines: DataFrame) -> DataFrame:
    """The contigs of a manifest's lines (``value``), in their order."""
    lines = lines.select(F.monotonically_increasing_id().alias("i"), F.split(F.trim("value"), r"\s+").alias("x")).where(F.size("x") >= 3)
    c = lines.select("i", F.col("x")[0].alias("path"), F.col("x")[1].alias("contig"), F.col("x")[2].cast("bigint").alias("length"))
    first = c.groupBy("path").agg(F.min("i").alias("f"))
    order = first.select("path", (F.row_number().over(W.orderBy("f")) - 1).alias("seq_idx"))  # a row per genome
    w = W.partitionBy("seq_idx").orderBy("i")
    c = c.join(order, "path").withColumn("contig_idx", F.row_number().over(w) - 1).withColumn("offset", F.sum("length").over(w) - F.col("length"))
    return c.select("seq_idx", "contig_idx", "contig", "length", "offset", "path")


def match_lines(table: DataFrame) -> DataFrame:
    """mum_id and ``value``, one line for each match: length, comma-separated starts, comma-separated strands."""
    from ..operators.layout import wide

    starts = F.array_join(F.transform("starts", lambda x: x.cast("string")), ",")
    strands = F.array_join(F.transform("strands", lambda x: F.when(x, F.lit("+")).otherwise(F.lit("-"))), ",")
    return wide(table).select("mum_id", F.concat_ws("\t", F.col("length").cast("string"), starts, strands).alias("value"))


def write_matches(table: DataFrame, path: str) -> None:
    match_lines(table).orderBy("mum_id").select("value").write.mode("overwrite").text(path)


def write_fasta(slices: DataFrame, path: str) -> None:
    """Header and sequence line of each slice, in order of path, contig, start."""
    slices.orderBy("path", "contig", "start").select(F.concat("header", F.lit("\n"), "slice").alias("value")).write.mode("overwrite").text(path)


def write_graph(blocks: DataFrame, links: DataFrame, walks: DataFrame, reference: str, path: str, sequences: DataFrame | None = None) -> None:
    """Graph in GFA 1.1: header, segments, links, walks. ``sequences`` (block, seq) gives the segments their letters; without
    it, or for blocks it lacks, they are ``*``."""
    blocks = blocks.withColumn("seq", F.lit(None).cast("string")) if sequences is None else blocks.join(sequences.select("block", "seq"), "block", "left")
    h = blocks.sparkSession.createDataFrame([(0, f"H\tVN:Z:1.1\tRS:Z:{reference}")], "k int, value string")
    s = blocks.select(F.lit(1).alias("k"), F.concat_ws("\t", F.lit("S"), F.concat(F.lit("b"), F.col("block").cast("string")), F.coalesce("seq", F.lit("*"))).alias("value"))
    name = lambda c: F.concat(F.lit("b"), F.col(c).cast("string"))
    l = links.select(F.lit(2).alias("k"), F.concat_ws("\t", F.lit("L"), name("a"), "a_dir", name("b"), "b_dir", F.lit("0M")).alias("value"))
    step = F.concat(F.when(F.col("direction") == "+", F.lit(">")).otherwise(F.lit("<")), F.lit("b"), F.col("block").cast("string"))
    w = walks.groupBy("seq_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", step.alias("x")))), lambda y: y["x"]), "").alias("p"))
    w = w.select(F.lit(3).alias("k"), F.concat_ws("\t", F.lit("W"), F.concat(F.lit("g"), F.col("seq_idx").cast("string")), F.lit("1"), F.lit("all"), F.lit("*"), F.lit("*"), "p").alias("value"))
    h.unionByName(s).unionByName(l).unionByName(w).orderBy("k").select("value").write.mode("overwrite").text(path)
