"""Queries over the remaining expressions and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bundle, catalogue, enrich, graph, manifest, orphans
from ..session import read_table
from ..sources import cards
from .registry import query
from .sql import CHUNKS, FILES, HASH, LIVE, MENTIONS, RECORDS, TAGS, with_


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.live_concepts(read_table(spark, sf_dir, "concepts"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.file_states(read_table(spark, sf_dir, "files"))


@query("SELECT doc_id, md5(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)\\b(archive|invoice)\\b', '<mark>\\1</mark>', 'g')) AS marked FROM documents WHERE text IS NOT NULL")
def prj18_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", F.md5(tx.highlight(F.col("text"), "the invoice from archive")).alias("marked"))


@query("SELECT DISTINCT mix, source, CASE WHEN target_share < 0.2e0 THEN 'weak' ELSE CAST(CAST(floor(target_share * 100 + 0.5e0) AS BIGINT) AS VARCHAR) || '%' END AS label FROM mix_targets")
def prj19_relevance_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "mix_targets").select("mix", "source", tx.relevance_label(F.col("target_share")).alias("label")).distinct()


@query(with_(LIVE) + "SELECT concept_id, '/' || concept_id || '.md' AS link FROM l")
def prj24_link_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("concept_id", tx.link_path(F.col("concept_id")).alias("link"))


@query(r"SELECT DISTINCT key, array_to_string(list_filter(regexp_split_to_array(lower(regexp_extract(trim(name), '^([^@\s]+)@[^@\s]+\.[^@\s]+$', 1)), '[^\p{L}\p{N}_]+'), lambda p: p <> ''), '.') AS parts FROM entities WHERE name IS NOT NULL")
def f18_mail_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "entities").filter("name IS NOT NULL").select("key", "name").distinct()
    return rows.select("key", F.array_join(tx.mail_parts(F.col("name")), ".").alias("parts")).distinct()


@query(with_(RECORDS) + r"SELECT source_hash, coalesce(regexp_matches(written_at, '(Z|[+-]\d\d:?\d\d)$') AND TRY_CAST(written_at AS TIMESTAMPTZ) IS NOT NULL, false) AS zoned FROM c")
def f23_zoned_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.concept_records(read_table(spark, sf_dir, "concepts"))
    return rows.select("source_hash", tx.zoned_instant(F.col("written_at")).alias("zoned"))


@query(with_(LIVE) + "SELECT concept_id, len(CAST(json_extract_string(coalesce(tags, '[]'), '$[*]') AS VARCHAR[])) AS tags, len(CAST(json_extract(coalesce(entities, '[]'), '$[*]') AS JSON[])) AS entities FROM l")
def f22_json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("concept_id", F.size("tags").cast("bigint").alias("tags"), F.size("entities").cast("bigint").alias("entities"))


@query(with_(CHUNKS) + "SELECT chunk_id, md5(chunk_id || '11') AS place FROM k")
def f26_hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.chunk_rows(read_table(spark, sf_dir, "chunks")).select("chunk_id", F.md5(F.concat("chunk_id", F.lit("11"))).alias("place"))


@query(with_(FILES, LIVE) + "SELECT concept_id, f.path FROM l JOIN f ON f.hash = l.source_hash")
def j6_concept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _files(spark, sf_dir).filter("hash IS NOT NULL").select(F.col("hash").alias("source_hash"), "path")
    return _live(spark, sf_dir).join(paths, "source_hash").select("concept_id", "path")


@query(f"SELECT {HASH.format('hash')} AS hash, substring({HASH.format('hash')}, 1, 2) AS shard, count(*) AS rows FROM extracts WHERE hash IS NOT NULL GROUP BY ALL")
def snk1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "extracts").select(orphans.normal_hash(F.col("hash")).alias("hash")).dropna()
    return rows.groupBy("hash", F.substring("hash", 1, 2).alias("shard")).agg(F.count(F.lit(1)).alias("rows"))


@query(r"SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> ''), 1, 20), ' ') AS excerpt FROM documents WHERE text IS NOT NULL")
def en2_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", enrich.excerpt(F.col("text"), 20).alias("excerpt"))


@query()
def en4_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read_table(spark, sf_dir, "extracts").filter("status = 'ok'").groupBy(orphans.normal_hash(F.col("hash")).alias("source_hash")).agg(F.min("extract_path").alias("name"), F.min("text").alias("text"))
    return enrich.enrich(texts)


@query("SELECT DISTINCT run_id, list_sort(list_filter(json_keys(stats), lambda k: k NOT IN ('seen'))) AS unknown FROM runs WHERE stats IS NOT NULL")
def set8_unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "runs").filter("stats IS NOT NULL").select("run_id", "stats").distinct()
    return rows.select("run_id", F.array_sort(F.array_except(F.json_object_keys("stats"), F.array(F.lit("seen")))).alias("unknown")).distinct()


@query(with_(LIVE) + "SELECT concept_id, CASE WHEN NOT regexp_matches(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 1 ELSE 0 END + CASE WHEN coalesce(trim(description), '') = '' THEN 1 ELSE 0 END AS errors FROM l")
def prj16_card_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-")
    card = F.to_json(F.struct(slug.alias("id"), F.lit("p").alias("project"), F.lit("2026-01-01T00:00:00Z").alias("occurred_at"), F.lit("t").alias("tool"), F.lit("s").alias("source_ref"), F.lit("paused").alias("status"), F.coalesce("description", F.lit("")).alias("summary")))
    return _live(spark, sf_dir).select("concept_id", F.size(cards.card_errors(card)).alias("errors"))


@query(with_(FILES, LIVE, TAGS, MENTIONS) + "SELECT concept_id, count(DISTINCT tag) AS n, 'tag' AS what FROM t GROUP BY 1 UNION ALL SELECT concept_id, count(DISTINCT key), 'entity' FROM m GROUP BY 1 UNION ALL SELECT concept_id, count(DISTINCT path), 'file' FROM l JOIN f ON hash = source_hash GROUP BY 1")
def agg23_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _live(spark, sf_dir)
    count = lambda rows, column, what: rows.groupBy("concept_id").agg(F.countDistinct(column).alias("n")).withColumn("what", F.lit(what))
    out = count(catalogue.concept_tags(live), "tag", "tag").unionByName(count(catalogue.concept_entities(live), "key", "entity"))
    return out.unionByName(count(j6_concept_files(spark, sf_dir), "path", "file"))


@query(with_(FILES, RECORDS) + ", d AS (SELECT source_hash FROM c WHERE coalesce(status, 'stable') <> 'deprecated' AND NOT EXISTS (SELECT 1 FROM f WHERE scan_status = 'included' AND f.hash = c.source_hash)) SELECT coalesce(c.status, 'stable') AS before, CASE WHEN d.source_hash IS NOT NULL THEN 'deprecated' ELSE coalesce(c.status, 'stable') END AS after, count(*) AS n FROM c LEFT JOIN d USING (source_hash) GROUP BY ALL")
def st7_drain_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = catalogue.concept_records(read_table(spark, sf_dir, "concepts"))
    gone = manifest.to_deprecate(_files(spark, sf_dir), records).select("source_hash", F.lit(True).alias("gone"))
    before = F.coalesce("status", F.lit("stable"))
    return records.join(gone, "source_hash", "left").groupBy(before.alias("before"), F.when(F.col("gone"), "deprecated").otherwise(before).alias("after")).agg(F.count(F.lit(1)).alias("n"))
