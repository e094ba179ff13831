"""Queries over text functions, chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import catalogue, chunking, evaluation, reports
from ..session import read_table
from .registry import query
from .sql import CHUNKS, LIVE, MENTIONS, TAGS, with_

_DOCS = "d AS (SELECT doc_id, text, title FROM documents WHERE text IS NOT NULL)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text", "title")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.chunk_rows(read_table(spark, sf_dir, "chunks"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.live_concepts(read_table(spark, sf_dir, "concepts"))


_W = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query("SELECT doc_id, title, CASE WHEN s = '' THEN 'untitled' WHEN length(s) <= 12 THEN s WHEN regexp_extract(left(s, 12), '^(.+)-[^-]*$', 1) <> '' THEN regexp_extract(left(s, 12), '^(.+)-[^-]*$', 1) ELSE left(s, 12) END AS slug FROM (SELECT doc_id, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents WHERE title IS NOT NULL)")
def f1_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").filter("title IS NOT NULL").select("doc_id", "title", tx.slugify(F.col("title"), 12).alias("slug"))


@query(r"SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS slug FROM documents WHERE title IS NOT NULL")
def f2_title_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").filter("title IS NOT NULL").select("doc_id", tx.title_slug(F.col("title")).alias("slug"))


@query(with_(_DOCS) + "SELECT doc_id, CAST(greatest(1, round_even(length(text) / 3.67e0, 0)) AS BIGINT) AS tokens FROM d")
def f4_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.estimate_tokens(F.col("text")).cast("bigint").alias("tokens"))


_UNIT = "chunks WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"


@query(f"SELECT DISTINCT chunk_id, round(sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm FROM {_UNIT}")
def f6_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vector")
    good = read_table(spark, sf_dir, "chunks").filter(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0))
    return good.select("chunk_id", F.round(vx.norm(v), 4).alias("norm")).distinct()


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f7_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(vx.dot(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(with_(_DOCS) + r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')) AS words FROM d")
def f9_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.word_count(F.col("text")).cast("bigint").alias("words"))


@query(with_(LIVE) + r"SELECT concept_id, regexp_extract(concept_id, '^(.*)/[^/]*$', 1) AS directory, '/' || concept_id || '.md' AS link FROM l")
def f15_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("concept_id", tx.directory(F.col("concept_id")).alias("directory"), F.concat(F.lit("/"), "concept_id", F.lit(".md")).alias("link"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\[([^\\]]*)\\]\\(([^)]+)\\)', 2)) AS links FROM documents WHERE text IS NOT NULL")
def f12_markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(tx.markdown_links(F.col("text"))).cast("bigint").alias("links"))


@query(with_(_DOCS) + r"""SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])[\t-\r ]+([A-Z("''\[])', '\1' || chr(57344) || '\2', 'g'), chr(57344))) AS sentences FROM d""")
def f19_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(tx.sentences(F.col("text"))).cast("bigint").alias("sentences"))


@query(with_(_DOCS) + r", t AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM d) SELECT term, count(*) AS n FROM t GROUP BY 1")
def f21_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.explode(tx.index_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(with_(LIVE) + "SELECT concept_id, CASE WHEN length(generated_at) >= 10 AND substring(generated_at, 5, 1) = '-' THEN left(generated_at, 10) ELSE '' END AS day FROM l")
def f24_date_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("concept_id", tx.date_prefix(F.col("generated_at")).alias("day"))


@query(r"SELECT DISTINCT target, regexp_replace(regexp_replace(trim(target), '\.md$', ''), '^/+|/+$', '', 'g') AS id FROM links_to")
def f25_clean_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "links_to").select("target", tx.clean_id(F.col("target")).alias("id")).distinct()


@query(with_(CHUNKS) + r"SELECT chunk_id, length(regexp_replace(regexp_replace(text, '(?m)^\s*```[\w-]*\s*$', '', 'g'), '[^\p{L}\p{N}_]', '', 'g')) >= 3 AS substantive FROM k")
def prj4_substantive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", tx.is_substantive(F.col("text")).alias("substantive"))


@query(with_("x AS (SELECT DISTINCT target AS name FROM links_to UNION SELECT DISTINCT name FROM entities WHERE name IS NOT NULL)") + rf"SELECT name, regexp_matches(trim(name), '^(https?://|www\.)', 'i') OR regexp_matches(trim(name), '{tx.FILE_EXTENSIONS}', 'i') OR (regexp_matches(trim(name), '{tx.SCRIPT_EXTENSIONS}', 'i') AND NOT regexp_matches(regexp_replace(trim(name), '{tx.SCRIPT_EXTENSIONS}', '', 'i'), '^\p{{Lu}}[\p{{L}}\p{{N}}]*$')) AS file_like FROM x")
def prj5_file_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read_table(spark, sf_dir, "links_to").select(F.col("target").alias("name")).union(read_table(spark, sf_dir, "entities").select("name").filter("name IS NOT NULL")).distinct()
    return names.select("name", tx.is_file_like(F.col("name")).alias("file_like"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(title, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda t: length(t) > 1), '|') AS terms FROM documents WHERE title IS NOT NULL")
def prj8_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").filter("title IS NOT NULL").select("doc_id", F.array_join(tx.query_terms(F.col("title")), "|").alias("terms"))


@query(with_(CHUNKS) + f", s AS (SELECT chunk_id, {_W.format('text')} AS t FROM k) SELECT chunk_id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(left(t, 60)) || '...' END AS snippet FROM s")
def prj9_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", tx.snippet(F.col("text"), 60).alias("snippet"))


@query(with_(CHUNKS) + "SELECT chunk_id, md5(title || CASE WHEN coalesce(heading_path, '') <> '' THEN ' > ' || heading_path ELSE '' END || chr(10) || chr(10) || text) AS input FROM k")
def prj11_embed_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", F.md5(chunking.embed_input(F.col("title"), F.col("heading_path"), F.col("text"))).alias("input"))


@query(with_(LIVE, TAGS, MENTIONS) + ", a AS (SELECT concept_id, count(DISTINCT tag) AS tags FROM t GROUP BY 1), b AS (SELECT concept_id, count(DISTINCT key) AS entities FROM m GROUP BY 1) SELECT l.concept_id, coalesce(a.tags, 0) AS tags, coalesce(b.entities, 0) AS entities FROM l LEFT JOIN a USING (concept_id) LEFT JOIN b USING (concept_id)")
def prj7_clean_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _live(spark, sf_dir)
    a = catalogue.concept_tags(live).groupBy("concept_id").agg(F.countDistinct("tag").alias("tags"))
    b = catalogue.concept_entities(live).groupBy("concept_id").agg(F.countDistinct("key").alias("entities"))
    return live.select("concept_id").join(a, "concept_id", "left").join(b, "concept_id", "left").na.fill(0, ["tags", "entities"])


@query(with_(_DOCS) + "SELECT doc_id, i AS piece, substring(text, CAST(i * 100 + 1 AS BIGINT), 100) AS part FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 100.0) AS BIGINT))) AS i FROM d WHERE length(text) > 0)")
def ch3_hard_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(tx.hard_cut(F.col("text"), 100)).alias("piece", "part"))
    return rows.select("doc_id", F.col("piece").cast("bigint").alias("piece"), "part")


_HEADED = r"""d0 AS (SELECT doc_id, regexp_replace(text, '\A<!--[ \t\r\n]*[^ \t\r\n]+ extraction.*?-->\s*', '', 's') AS x FROM documents WHERE text IS NOT NULL),
d1 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '(?m)^<!-- page \d+ -->[ \t\n\v\f\r]*$', '', 'g'), '^[ \t\n\v\f\r]+', ''), '[ \t\n\v\f\r]+$', '') AS x FROM d0),
n AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM d1),
h AS (SELECT *, length(regexp_extract(line, '^(#{1,6})\s+(.*?)\s*#*$', 1)) AS level, trim(regexp_extract(line, '^(#{1,6})\s+(.*?)\s*#*$', 2), ' ') AS title FROM n),
s AS (SELECT *, CAST(sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS sec FROM h), hd AS (SELECT doc_id, sec, level, title FROM s WHERE level > 0),
p AS (SELECT a.doc_id, a.sec, string_agg(g.title, ' > ' ORDER BY g.sec) AS path FROM hd a JOIN hd g ON g.doc_id = a.doc_id AND g.sec <= a.sec WHERE NOT EXISTS (SELECT 1 FROM hd x WHERE x.doc_id = g.doc_id AND x.sec > g.sec AND x.sec <= a.sec AND x.level <= g.level) GROUP BY 1, 2),
b AS (SELECT doc_id, sec, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY i), '^[ \t\n\v\f\r]+', ''), '[ \t\n\v\f\r]+$', '') AS body FROM s WHERE level = 0 GROUP BY 1, 2)"""


@query(with_(_HEADED) + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INTEGER) AS n, coalesce(path, '') AS path, body FROM b LEFT JOIN p USING (doc_id, sec) WHERE body <> ''")
def ch2_heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.heading_sections(chunking.strip_artifacts(F.col("text")))).alias("n", "s"))
    return rows.select("doc_id", "n", F.col("s.path").alias("path"), F.col("s.body").alias("body"))


def _as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("concept_id"), F.col("title").alias("summary"), "text")


@query()
def ch6_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_as_documents(spark, sf_dir), max_tokens=100)


@query()
def ch8_transcript_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_as_documents(spark, sf_dir), "transcript", 100)


@query(with_(CHUNKS) + "SELECT count(*) AS chunks, count(DISTINCT concept_id) AS concepts, round(avg(tokens), 6) AS mean_tokens, CAST(max(tokens) AS BIGINT) AS max_tokens, CAST(sum(tokens) AS BIGINT) AS tokens FROM k")
def agg11_chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chunk_totals(_chunks(spark, sf_dir))


@query(with_(CHUNKS) + "SELECT source, concept_type, count(*) AS n FROM k GROUP BY ALL")
def agg11_chunks_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("source", "concept_type").agg(F.count(F.lit(1)).alias("n"))


@query(with_(LIVE) + "SELECT concept_type, sensitivity, count(*) AS n FROM l GROUP BY ALL")
def agg12_bundle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).groupBy("concept_type", "sensitivity").agg(F.count(F.lit(1)).alias("n"))


@query(with_(CHUNKS) + "SELECT concept_id, string_agg('**' || coalesce(heading_path, 'Unknown') || ':** ' || text, chr(10) || chr(10) ORDER BY chunk_index, chunk_id) AS body FROM k GROUP BY 1")
def snk13_meeting_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.meetings import transcript_markdown

    return transcript_markdown(_chunks(spark, sf_dir), "concept_id", ["chunk_index", "chunk_id"], "heading_path", "text")


@query(with_(CHUNKS) + r""", s AS (SELECT chunk_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z("''\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM k), e AS (SELECT chunk_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS n FROM s),
w AS (SELECT *, len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '')) AS words FROM e) SELECT chunk_id, sentence FROM w WHERE words BETWEEN 8 AND 40 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY words DESC, n) = 1""")
def w12_held_out_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.held_out_sentence(_chunks(spark, sf_dir))
