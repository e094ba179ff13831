"""Reports over the census, extraction and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import error_class


def folder_megabytes(spark: SparkSession, path: str) -> float:
    """The size of a folder or file in megabytes, as its file system tells; 0 if it is not there."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(context._jsc.hadoopConfiguration())
    return fs.getContentSummary(where).getLength() / 1e6 if fs.exists(where) else 0.0


def scan_status(files: DataFrame) -> DataFrame:
    """Files and bytes by scan status."""
    return files.groupBy("scan_status").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def top_extensions(files: DataFrame, most: int = 15) -> DataFrame:
    """The commonest extensions of included files; ``(none)`` for none."""
    ext = F.when(F.coalesce("ext", F.lit("")) == "", "(none)").otherwise(F.col("ext")).alias("ext")
    rows = files.filter(F.col("scan_status") == "included").groupBy(ext).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return rows.orderBy(F.desc("files"), "ext").limit(most)


def duplication(files: DataFrame) -> DataFrame:
    """Included and hashed files, distinct hashes, and the share that is copies."""
    rows = files.filter((F.col("scan_status") == "included") & F.col("hash").isNotNull()).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("hash").alias("hashes"))
    return rows.withColumn("copied_share", F.when(F.col("files") > 0, F.round(1 - F.col("hashes") / F.col("files"), 6)).otherwise(0.0))


def extraction_status(files: DataFrame) -> DataFrame:
    """Distinct hashes and words by extraction status."""
    rows = files.filter((F.col("scan_status") == "included") & F.col("hash").isNotNull()).select("hash", "extract_status", "word_count").distinct()
    return rows.groupBy("extract_status").agg(F.count(F.lit(1)).alias("hashes"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


def total_words(files: DataFrame) -> DataFrame:
    rows = files.filter((F.col("extract_status") == "ok") & F.col("hash").isNotNull()).select("hash", "word_count").distinct()
    return rows.agg(F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


def engines(files: DataFrame) -> DataFrame:
    """Distinct hashes and words (of all copies) by engine."""
    rows = files.filter((F.col("extract_status") == "ok") & F.col("extract_engine").isNotNull())
    return rows.groupBy("extract_engine").agg(F.countDistinct("hash").alias("hashes"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


def failure_groups(files: DataFrame, most: int = 20) -> DataFrame:
    """Failed extractions by extension, status and class of error, with an example."""
    rows = files.filter(F.col("extract_status").isin("failed", "empty", "skipped"))
    once = rows.groupBy("ext", "extract_status", "error").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("example"))
    grouped = once.groupBy("ext", "extract_status", error_class(F.col("error")).alias("error_class")).agg(F.sum("n").alias("files"), F.min("example").alias("example"))
    return grouped.orderBy(F.desc("files"), "ext", "extract_status", "error_class").limit(most)


def success_rate(files: DataFrame) -> DataFrame:
    """Attempted and successful extractions of distinct hashes."""
    rows = files.filter((F.col("scan_status") == "included") & F.col("hash").isNotNull()).select("hash", "extract_status").distinct()
    sums = rows.agg(F.sum((F.col("extract_status") != "pending").cast("long")).alias("attempted"), F.sum((F.col("extract_status") == "ok").cast("long")).alias("ok"))
    return sums.withColumn("rate", F.when(F.col("attempted") > 0, F.round(F.col("ok") / F.col("attempted"), 6)))


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """Chunks, concepts and tokens of the index."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("concept_id").alias("concepts"), F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.max("tokens").cast("long").alias("max_tokens"), F.sum("tokens").alias("tokens")
    )


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
