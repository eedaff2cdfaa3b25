"""The driver's tables as the library's relations (all integers, same formulas in the SQL twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

GENOMES, SLOT = 5, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total(spark: SparkSession, sf_dir: str) -> int:
    """Number of matches (dense order keys)."""
    return (table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0) + 1


def mums(spark: SparkSession, sf_dir: str, slot: int = SLOT) -> DataFrame:
    """mum_id, seq_idx, start, length, strand; one row for each match and genome."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("i"), F.col("o_custkey").cast("bigint").alias("c"))
    # joined, not exploded: the planner takes an exploded table for as small as its file and broadcasts it
    genomes = spark.range(0, GENOMES, 1, 1).select(F.col("id").cast("int").alias("j"))
    m = o.crossJoin(F.broadcast(genomes))
    m = m.withColumn("b", F.expr("i div 64")).withColumn("inv", F.expr("j > 0 and (b + j) % 11 = 0"))
    at = F.expr("case when inv then b * 64 + 63 - i % 64 when j = 2 and i % 37 = 5 and i % 64 <> 63 then i + 1 when j = 2 and i % 37 = 6 and i % 64 <> 0 then i - 1 else i end")
    return m.select(
        F.col("i").alias("mum_id"),
        F.col("j").alias("seq_idx"),
        (at * slot + F.expr("(c * (j + 3) + i) % 136")).cast("bigint").alias("start"),
        F.expr("20 + c % 100").cast("bigint").alias("length"),
        (~F.col("inv")).alias("strand"),
    )


def mums_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that some genomes lack (start -1)."""
    gone = F.expr("seq_idx > 0 and mum_id % 29 = seq_idx")
    return mums(spark, sf_dir).withColumn("start", F.when(gone, F.lit(-1).cast("bigint")).otherwise(F.col("start")))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = total(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("contig"))
    c = nation.select("k", "contig", F.explode(F.sequence(F.lit(0), F.lit(GENOMES - 1))).alias("seq_idx"))
    c = c.withColumn("length", (F.lit(-(-n * SLOT // 25)) + F.expr("(k * 37 + seq_idx * 101) % 1000")).cast("bigint"))
    before = F.sum("length").over(W.partitionBy("seq_idx").orderBy("k"))
    return c.select("seq_idx", F.col("k").cast("int").alias("contig_idx"), "contig", "length", (before - F.col("length")).alias("offset"), F.concat(F.lit("g"), F.col("seq_idx").cast("string"), F.lit(".fa")).alias("path"))


def regions(spark: SparkSession, sf_dir: str, short: bool = False) -> DataFrame:
    """region_id, seq_idx, start, end (global, half-open)."""
    span = total(spark, sf_dir) * SLOT - 60000
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("region_id"), F.col("s_nationkey").cast("bigint").alias("k"))
    size = F.expr("500 + k * 50") if short else F.expr("1000 + k * 1000")
    start = (F.col("region_id") * 38197 + (1500 if short else 0)) % span
    return s.select("region_id", (F.col("region_id") % 5).cast("int").alias("seq_idx"), start.alias("start"), (start + size).alias("end"))


def local_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, seq_idx, region (text, contig:start-end); some name no contig or leave theirs."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("i"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name")
    start = (F.col("i") * 37) % 1000
    end = F.when(F.col("i") % 7 == 3, F.lit(10**12)).otherwise(start + 100)
    name = F.when(F.col("i") % 10 == 4, F.lit("nowhere")).otherwise(F.col("n_name"))
    text = F.concat(name, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("bigint").cast("string"))
    return s.join(F.broadcast(n), F.col("i") % 25 == F.col("k")).select(F.col("i").alias("region_id"), (F.col("i") % 5).cast("int").alias("seq_idx"), text.alias("region"))  # nation has 25 rows


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, start, end, path: a slice of each document."""
    d = table(spark, sf_dir, "documents").where("n_chars > 0").select(F.col("doc_id").cast("bigint").alias("i"), F.col("n_chars").cast("bigint").alias("n"), "source")
    start = (F.col("i") * 131) % F.col("n")
    return d.select(F.concat(F.lit("doc"), F.col("i").cast("string")).alias("contig"), start.alias("start"), F.least(F.col("n"), start + 80).alias("end"), F.col("source").alias("path"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, contig, seq: documents as sequences."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("path"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("contig"), F.col("text").alias("seq"))
