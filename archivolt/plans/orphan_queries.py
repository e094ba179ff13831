"""Queries over references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orphans
from ..session import read_table
from .registry import query

_TABLES = ("files", "concepts", "extracts", "links_to")

_HASH = "replace(regexp_replace(lower({}), '\\s+', '', 'g'), 'blake3:', '')"
_SQL = f"""
WITH RECURSIVE latest AS (
  SELECT hash, scan_status, rank() OVER (PARTITION BY path ORDER BY CAST(last_seen AS TIMESTAMPTZ) DESC) AS n FROM files
), live_hash AS (
  SELECT DISTINCT {_HASH.format('hash')} AS h FROM latest WHERE n = 1 AND coalesce(scan_status, '') <> 'missing' AND hash IS NOT NULL
), live_id AS (
  SELECT DISTINCT concept_id AS h FROM concepts WHERE coalesce(status, '') <> 'deprecated' AND concept_id IS NOT NULL
), cleaned AS (
  SELECT from_id, seen_at, target, regexp_replace(target, '[#?].*$', '', 's') AS plain FROM links_to
), body AS (
  SELECT from_id, seen_at, CASE WHEN starts_with(plain, '/') THEN regexp_replace(left(plain, length(plain) - 3), '^/+', '')
      ELSE regexp_extract(from_id, '^(.*)/[^/]*$', 1) || '/' || left(plain, length(plain) - 3) END AS p
  FROM cleaned
  WHERE NOT regexp_matches(target, '^(http://|https://|mailto:|file://|#)') AND ends_with(plain, '.md')
), tidy AS (
  SELECT from_id, seen_at, p, array_to_string(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.'), '/') AS q, 0 AS depth FROM body
  UNION ALL
  SELECT from_id, seen_at, p, ltrim(regexp_replace('/' || q, '/(?:[^/.][^/]*|\\.[^/.][^/]*|\\.\\.[^/]+)/\\.\\.(/|$)', '\\1'), '/'), depth + 1 FROM tidy
  WHERE regexp_matches('/' || q, '/(?:[^/.][^/]*|\\.[^/.][^/]*|\\.\\.[^/]+)/\\.\\.(/|$)') AND depth < 64
), resolved AS (
  SELECT from_id, seen_at, trim(q, '/') AS t FROM tidy WHERE NOT regexp_matches('/' || q, '/(?:[^/.][^/]*|\\.[^/.][^/]*|\\.\\.[^/]+)/\\.\\.(/|$)')
), refs AS (
  SELECT 'concepts' AS ref_table, concept_id AS ref_key, {_HASH.format('source_hash')} AS target_key, CAST(generated_at AS TIMESTAMPTZ) AS moment FROM concepts WHERE source_hash IS NOT NULL
  UNION ALL SELECT 'extracts', extract_path, {_HASH.format('hash')}, CAST(extracted_at AS TIMESTAMPTZ) FROM extracts WHERE hash IS NOT NULL
  UNION ALL SELECT 'links_to', from_id, t, CAST(seen_at AS TIMESTAMPTZ) FROM resolved
), orphan AS (
  SELECT * FROM refs WHERE (ref_table = 'links_to' AND target_key NOT IN (SELECT h FROM live_id))
    OR (ref_table <> 'links_to' AND target_key NOT IN (SELECT h FROM live_hash))
)
"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.catalogue_orphans(*[read_table(spark, sf_dir, t) for t in _TABLES])


@query(_SQL + "SELECT DISTINCT ref_table, ref_key, target_key FROM orphan")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_key", "target_key").distinct()


@query(
    _SQL
    + """, o AS (SELECT DISTINCT ref_table, ref_key, target_key, strftime(moment AT TIME ZONE 'UTC', '%Y-%m') AS month FROM orphan)
SELECT ref_table, month, count(*) AS orphans, count(DISTINCT target_key) AS missing_targets FROM o GROUP BY ALL"""
)
def p3_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphans_by_month(*[read_table(spark, sf_dir, t) for t in _TABLES])


_KEYS = f"""WITH r AS (SELECT DISTINCT chunk_id, CASE WHEN chunk_index % 5 = 3 THEN NULL ELSE concept_id END AS concept_id, CASE WHEN source IS NULL THEN NULL ELSE {_HASH.format('source_hash')} END AS source_hash FROM chunks),
t AS (SELECT DISTINCT concept_id, {_HASH.format('source_hash')} AS source_hash FROM concepts WHERE coalesce(status, '') <> 'deprecated') SELECT chunk_id, concept_id, source_hash FROM r WHERE """
_NONE = "NOT EXISTS (SELECT 1 FROM t WHERE (r.concept_id IS NULL OR t.concept_id = r.concept_id) AND (r.source_hash IS NULL OR t.source_hash = r.source_hash))"


def _composite(spark: SparkSession, sf_dir: str, match: str) -> DataFrame:
    """Chunks refer to a concept by its id and the hash of its source; every fifth does not name the concept, some do not
    name the source. Orphans under a match semantics."""
    chunks, concepts = read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "concepts")
    refs = chunks.select("chunk_id", F.when(F.col("chunk_index") % 5 != 3, F.col("concept_id")).alias("concept_id"), F.when(F.col("source").isNotNull(), orphans.normal_hash(F.col("source_hash"))).alias("source_hash")).distinct()
    live = concepts.filter("coalesce(status, '') <> 'deprecated'").select("concept_id", orphans.normal_hash(F.col("source_hash")).alias("source_hash"))
    return orphans.orphan_references(refs, ["concept_id", "source_hash"], live, ["concept_id", "source_hash"], match)


@query(_KEYS + "concept_id IS NOT NULL AND source_hash IS NOT NULL AND " + _NONE)
def p3_simple_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composite(spark, sf_dir, "simple")


@query(_KEYS + "(concept_id IS NOT NULL OR source_hash IS NOT NULL) AND " + _NONE)
def p3_partial_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composite(spark, sf_dir, "partial")


@query(_KEYS + "(concept_id IS NULL) <> (source_hash IS NULL) OR (concept_id IS NOT NULL AND source_hash IS NOT NULL AND " + _NONE + ")")
def p3_full_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composite(spark, sf_dir, "full")
