"""The catalogue's tables as they stand: one row for each path, record and chunk.

The stored tables hold repeated rows and several states of a key; these operators
reduce them by an aggregation that combines on the map side, so a key in a third
of all rows costs one row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, entity_key, fold_case
from .orphans import normal_hash

FILE_COLUMNS = ("path", "root", "ext", "size", "inode", "mtime", "mime", "hash", "extract_path", "extract_engine", "error", "run_id", "scan_status", "extract_status", "word_count", "first_seen", "last_seen")
CONCEPT_COLUMNS = ("source_hash", "concept_id", "concept_type", "title", "description", "tags", "entities", "sensitivity", "status", "enrich_status", "error", "model", "generated_at", "ingest_run", "written_at")
CHUNK_COLUMNS = ("chunk_id", "concept_id", "source_hash", "source", "concept_type", "sensitivity", "title", "heading_path", "chunk_index", "text", "tokens", "model")

_LATE = 1 << 62


def newest_first(instant: Column) -> Column:
    """A key by which the latest instant sorts first; texts that are no instant sort last."""
    return F.coalesce(-F.unix_micros(F.try_to_timestamp(instant)), F.lit(_LATE))


def file_states(files: DataFrame) -> DataFrame:
    """The latest state of each path, its hash in normal notation. Paths that are null are left out."""
    row = F.struct(*[F.col(c) for c in FILE_COLUMNS])
    order = F.struct(newest_first(F.col("last_seen")), F.col("hash"), F.col("scan_status"))
    latest = files.filter(F.col("path").isNotNull()).groupBy("path").agg(F.min_by(row, order).alias("r")).select("r.*")
    return latest.withColumn("hash", normal_hash(F.col("hash")))


def concept_records(concepts: DataFrame) -> DataFrame:
    """The latest record of each source hash, with tags and entities as arrays (empty where null or malformed)."""
    rows = concepts.filter(F.col("source_hash").isNotNull()).withColumn("source_hash", normal_hash(F.col("source_hash")))
    order = F.struct(newest_first(F.col("written_at")), newest_first(F.col("generated_at")), *[F.col(c) for c in ("concept_id", "title", "description", "tags", "entities")])
    latest = rows.groupBy("source_hash").agg(F.min_by(F.struct(*[F.col(c) for c in CONCEPT_COLUMNS]), order).alias("r")).select("r.*")
    empty = F.array()
    return latest.withColumn("tags", F.coalesce(F.from_json("tags", "array<string>"), empty.cast("array<string>"))).withColumn(
        "entities", F.coalesce(F.from_json("entities", "array<struct<name:string,kind:string>>"), empty.cast("array<struct<name:string,kind:string>>"))
    )


def live_concepts(concepts: DataFrame) -> DataFrame:
    """Records that have an id and are not deprecated."""
    return concept_records(concepts).filter(F.col("concept_id").isNotNull() & (F.coalesce("status", F.lit("stable")) != "deprecated"))


def concept_tags(records: DataFrame) -> DataFrame:
    """concept_id, tag: every tag as written in lower case with white space collapsed; repeated as often as mentioned."""
    rows = records.select("concept_id", F.explode("tags").alias("t")).select("concept_id", F.lower(collapse(F.col("t"))).alias("tag"))
    return rows.filter(F.col("tag") != "")


def concept_entities(records: DataFrame) -> DataFrame:
    """concept_id, name, kind, key: every mention; names without a letter of text are dropped."""
    rows = records.select("concept_id", F.explode("entities").alias("e")).select("concept_id", collapse(F.col("e.name")).alias("name"), F.lower("e.kind").alias("kind"))
    return rows.filter((F.col("name") != "") & F.col("kind").isNotNull()).withColumn("key", entity_key(F.col("name"), F.col("kind")))


def link_terms(records: DataFrame) -> DataFrame:
    """concept_id, term, weight: distinct tags (1.0) and entities (1.5) by which concepts are linked."""
    tags = records.select("concept_id", F.explode("tags").alias("t")).select("concept_id", F.concat(F.lit("tag:"), F.lower(collapse(F.col("t")))).alias("term"), F.lit(1.0).alias("weight"))
    ents = records.select("concept_id", F.explode("entities").alias("e")).select("concept_id", F.concat(F.lit("entity:"), F.lower("e.kind"), F.lit(":"), fold_case(collapse(F.col("e.name")))).alias("term"), F.lit(1.5).alias("weight"))
    return tags.unionByName(ents).dropna().distinct()


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """One row for each chunk_id, without vectors."""
    rest = [c for c in CHUNK_COLUMNS if c != "chunk_id"]
    return chunks.filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min(F.struct(*[F.col(c) for c in rest])).alias("r")).select("chunk_id", "r.*")
