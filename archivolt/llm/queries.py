"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import abuse, byte_pair, mixing, name_variants, scanned_text, set_pairs, similar_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_P1_SQL = """
WITH v AS (
  SELECT DISTINCT c.model, c.chunk_id, list_transform(c.vector, lambda x: CAST(x AS DOUBLE)) AS v
  FROM chunks c JOIN embedders e ON c.model = e.model AND len(c.vector) = e.dim
  WHERE len(list_filter(c.vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(c.vector, lambda x: x <> 0)) > 0
), s AS (
  SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.v, b.v) AS sim
  FROM v a JOIN v b ON a.model = b.model AND a.chunk_id <> b.chunk_id
), r AS (
  SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY round(sim, 6) DESC, b) AS n FROM s
)
"""


@_query(_P1_SQL + "SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE n <= 5 AND sim >= 0.9")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors.similar_pairs(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "embedders"))


@_query(_P1_SQL + "SELECT a AS chunk_id, b AS neighbour_id, round(sim, 4) AS similarity, n AS rank FROM r WHERE n <= 5")
def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every usable chunk, however unlike they are."""
    rows = similar_vectors.nearest_vectors(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "embedders"))
    return rows.select("chunk_id", "neighbour_id", F.round("similarity", 4).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@_query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.variant_pairs(read_table(spark, sf_dir, "entities"))


@_query()
def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.variant_groups(read_table(spark, sf_dir, "entities"))


@_query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned_text.noisy_lines(read_table(spark, sf_dir, "extracts"))


@_query()
def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned_text.paragraphs(read_table(spark, sf_dir, "extracts"))


_P5_SQL = """
WITH c AS (
  SELECT DISTINCT concept_id, replace(lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))), 'ß', 'ss') AS m
  FROM (SELECT concept_id, unnest(CAST(json_extract_string(tags, '$[*]') AS VARCHAR[])) AS t FROM concepts WHERE concept_id IS NOT NULL AND tags IS NOT NULL)
  WHERE t IS NOT NULL
  UNION
  SELECT DISTINCT concept_id, lower(e ->> 'kind') || ':' || replace(lower(trim(regexp_replace(e ->> 'name', '\\s+', ' ', 'g'))), 'ß', 'ss')
  FROM (SELECT concept_id, unnest(CAST(json_extract(entities, '$[*]') AS JSON[])) AS e FROM concepts WHERE concept_id IS NOT NULL AND entities IS NOT NULL)
), n AS (SELECT concept_id, count(*) AS n FROM c WHERE m <> '' GROUP BY 1),
p AS (SELECT a.concept_id AS a, b.concept_id AS b, count(*) AS s FROM c a JOIN c b ON a.m = b.m AND a.concept_id < b.concept_id WHERE a.m <> '' GROUP BY 1, 2)
SELECT a AS concept_a, b AS concept_b{} FROM p JOIN n x ON x.concept_id = a JOIN n y ON y.concept_id = b
WHERE s / (x.n + y.n - s) >= 0.6 - 1e-12
"""


def _concept_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_pairs.concept_lists(read_table(spark, sf_dir, "concepts"))


@_query(_P5_SQL.format(""))
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = set_pairs.similar_records(_concept_lists(spark, sf_dir), "concept_id", "members")
    return rows.select(F.col("concept_id_a").alias("concept_a"), F.col("concept_id_b").alias("concept_b"))


@_query(_P5_SQL.format(", round(s / (x.n + y.n - s), 6) AS similarity"))
def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = set_pairs.similar_records(_concept_lists(spark, sf_dir), "concept_id", "members")
    return rows.select(F.col("concept_id_a").alias("concept_a"), F.col("concept_id_b").alias("concept_b"), F.round("similarity", 6).alias("similarity"))


@_query(
    _P5_SQL.format("").split("SELECT a AS concept_a")[0]
    + """, g AS (SELECT concept_id, list_sort(list(m)) AS own FROM c WHERE m <> '' GROUP BY 1), h AS (SELECT own, min(concept_id) AS class_id, count(*) AS copies FROM g GROUP BY 1),
v AS (SELECT class_id, unnest(own) AS m, len(own) AS n FROM h), w AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS s, x.n + y.n AS sizes FROM v x JOIN v y ON x.m = y.m AND x.class_id <> y.class_id GROUP BY x.class_id, y.class_id, x.n, y.n),
k AS (SELECT a, count(*) AS links FROM w WHERE s / (sizes - s) >= 0.6 - 1e-12 GROUP BY 1)
SELECT concept_id, class_id, copies, coalesce(links, 0) AS links FROM g JOIN h USING (own) LEFT JOIN k ON k.a = class_id"""
)
def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_pairs.record_classes(_concept_lists(spark, sf_dir), "concept_id", "members")


@_query()
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pair.encode(read_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query()
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


@_query()
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_shares(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def _documents_and_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "abuse_labels")


@_query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abusive_documents(*_documents_and_labels(spark, sf_dir)).select("doc_id")


@_query()
def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(*_documents_and_labels(spark, sf_dir))


@_query()
def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abuse_by_source(*_documents_and_labels(spark, sf_dir))
