"""Queries of operators that the engine's stages use, each by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bundle, catalogue, chunking, evaluation, graph, index, manifest
from ..session import read_table
from ..sources import cards, extract, frontmatter
from ..sources.bundles import rendered
from .graph_queries import bnd1_related, gr9_duplicate_candidates
from .registry import ORACLES, query
from .sql import CHUNKS, FILES, LIVE, with_


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.live_concepts(read_table(spark, sf_dir, "concepts"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.chunk_rows(read_table(spark, sf_dir, "chunks"))


_RUNS = "u AS (SELECT run_id, max(command) AS command, max(started_at) AS started_at, max(finished_at) AS finished_at, max(stats) AS stats FROM runs WHERE run_id IS NOT NULL GROUP BY 1)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "runs").filter("run_id IS NOT NULL")
    return rows.groupBy("run_id").agg(*[F.max(c).alias(c) for c in ("command", "started_at", "finished_at", "stats")])


@query("WITH " + _RUNS + " SELECT run_id, command, started_at FROM u WHERE started_at IS NOT NULL AND finished_at IS NULL UNION ALL SELECT 'new-2', 'extract', '2030-01-02'")
def man5_unfinished_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs begin, one of them ends: the other is unfinished, like those of the table without an end."""
    rows = manifest.start_run(_runs(spark, sf_dir), "new-1", "scan", "2030-01-01")
    rows = manifest.start_run(rows, "new-2", "extract", "2030-01-02")
    rows = manifest.finish_run(rows, "new-1", "2030-01-03", "{}")
    return manifest.unfinished_runs(rows).select("run_id", "command", "started_at")


@query("WITH t AS (SELECT DISTINCT extract_path, text FROM extracts WHERE text IS NOT NULL), a AS (SELECT extract_path, text, regexp_replace(text, '\\A<!--[ \\t\\r\\n]*[^ \\t\\r\\n]+ extraction.*?-->\\s*', '', 's') AS x FROM t) SELECT extract_path, md5(regexp_replace(regexp_replace(regexp_replace(x, '(?m)^<!-- page \\d+ -->[ \\t\\n\\v\\f\\r]*$', '', 'g'), '^[ \\t\\n\\v\\f\\r]+', ''), '[ \\t\\n\\v\\f\\r]+$', '')) AS bare FROM a")
def ch1_strip_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "extracts").filter("text IS NOT NULL").select("extract_path", "text").distinct()
    return rows.select("extract_path", F.md5(chunking.strip_artifacts(F.col("text"))).alias("bare"))


@query("SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t\\n\\v\\f\\r]*\\n'), lambda p: regexp_replace(regexp_replace(p, '^[ \\t\\n\\v\\f\\r]+', ''), '[ \\t\\n\\v\\f\\r]+$', '')), lambda p: p <> '') AS parts FROM documents WHERE text IS NOT NULL")
def f20_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", tx.paragraphs(F.col("text")).alias("parts"))


@query(with_(CHUNKS) + "SELECT tokens, CAST(floor(tokens * 3.67e0) AS INTEGER) AS chars, count(*) AS chunks FROM k GROUP BY 1")
def f5_tokens_to_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("tokens", tx.tokens_to_chars(F.col("tokens")).alias("chars")).agg(F.count(F.lit(1)).alias("chunks"))


@query(with_(LIVE) + "SELECT concept_id AS path, regexp_replace(concept_id, '^/+', '') AS concept_id FROM l")
def f14_concept_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _live(spark, sf_dir)
    return live.select(F.col("concept_id").alias("path"), tx.concept_of_path(F.concat(F.lit("/"), "concept_id", F.lit(".md"))).alias("concept_id"))


@query(with_(FILES) + "SELECT path, strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM f")
def f16_modified_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.file_states(read_table(spark, sf_dir, "files")).select("path", tx.utc_day(F.col("mtime")).alias("day"))


@query("WITH x AS (" + ORACLES["gr9_duplicate_candidates"] + "), o AS (SELECT key, max(occurrence_count) AS n FROM entities WHERE key IS NOT NULL GROUP BY 1), y AS (SELECT key_a, key_b, reason, CASE reason WHEN 'contained' THEN 1 WHEN 'email' THEN 2 ELSE 0 END AS rank, a.n + b.n AS occurrences FROM x JOIN o a ON a.key = key_a JOIN o b ON b.key = key_b) SELECT *, row_number() OVER (ORDER BY rank DESC, occurrences DESC, key_a, key_b, reason) AS place FROM y QUALIFY place <= 200")
def w15_review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 rows of the review, numbered."""
    nodes = read_table(spark, sf_dir, "entities").filter("key IS NOT NULL").groupBy("key").agg(F.max("occurrence_count").alias("occurrence_count"))
    rows = graph.review_order(gr9_duplicate_candidates(spark, sf_dir), nodes).limit(200)
    return rows.select("*", graph.numbered_rows(["rank", "occurrences"], ["key_a", "key_b", "reason"]).cast("bigint").alias("place"))


@query(with_(LIVE) + ", x AS (SELECT concept_id, concept_type, row_number() OVER (PARTITION BY concept_type ORDER BY concept_id) - 1 AS i, count(*) OVER (PARTITION BY concept_type) AS n FROM l), y AS (SELECT *, n // 2 AS m FROM x), z AS (SELECT concept_id, concept_type, CAST(CASE WHEN i = m THEN 0 WHEN i < m THEN 2 * (m - i) - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END ELSE 2 * (i - m) - CASE WHEN n % 2 = 0 THEN 0 ELSE 1 END END AS BIGINT) AS turn FROM y) SELECT concept_id, concept_type, turn FROM z ORDER BY turn, concept_type LIMIT 40")
def w10_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.sampled_by_type(_live(spark, sf_dir), 40).select("concept_id", "concept_type", F.col("turn").cast("bigint").alias("turn"))


_COUNT = "len(list_filter(regexp_split_to_array({}, '[\\s\\p{{Z}}\\x{{85}}]+'), lambda w: w <> ''))"


@query(with_(CHUNKS) + f", s AS (SELECT chunk_id, concept_id, text, {_COUNT.format('text')} AS n FROM k), w AS (SELECT concept_id FROM s GROUP BY 1 HAVING sum(n) BETWEEN 200 AND 20000) SELECT chunk_id, text FROM s WHERE n >= 20 AND concept_id IN (SELECT concept_id FROM w) ORDER BY md5(chunk_id || '11'), chunk_id LIMIT 100")
def ev5_collect_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.collect_chunks(_chunks(spark, sf_dir), 100, least=20)


@query("SELECT concept_id, peer, place - 1 AS place FROM (" + ORACLES["bnd1_related"] + ")")
def gr19_related_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts that each rendered document links to, in order of appearance, without itself; read back from the markdown."""
    from ..operators import orphans

    live = _live(spark, sf_dir)
    docs = bundle.documents(live, live.select("source_hash", F.lit(None).cast("string").alias("path")), bundle.related(live))
    links = docs.select("concept_id", F.posexplode(tx.markdown_links(F.col("body"))).alias("place", "target"))
    links = links.select("concept_id", "place", orphans.link_concept(F.col("concept_id"), F.col("target")).alias("peer")).filter(F.col("peer") != F.col("concept_id"))
    return graph.first_per(links, "concept_id", ["place"], 8).groupBy("concept_id", "peer").agg(F.min("place").cast("bigint").alias("place"))


_CARD = "c AS (SELECT trim(run_id) AS id, substr(started_at, 1, 7) AS month, started_at, command, coalesce(stats, '{}') AS stats FROM u WHERE regexp_matches(run_id, '^[a-z0-9]+(-[a-z0-9]+)*$') AND started_at IS NOT NULL)"


@query("WITH " + _RUNS + ", " + _CARD + " SELECT 'p/sessions/' || month || '/' || id || '.md' AS path, '# ' || command || chr(10) || chr(10) || '- Tool: engine' || chr(10) || '- Source: ' || id || chr(10) || '- Status: completed' || chr(10) || '- When: ' || started_at || chr(10) AS head FROM c")
def snk11_session_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run as a card: checked, then rendered; the part before the lists."""
    runs = _runs(spark, sf_dir).filter("started_at IS NOT NULL")
    card = F.to_json(F.struct(F.col("run_id").alias("id"), F.lit("p").alias("project"), F.col("started_at").alias("occurred_at"), F.lit("engine").alias("tool"), F.col("run_id").alias("source_ref"), F.lit("completed").alias("status"), F.col("command").alias("summary")))
    rows = cards.valid_cards(runs.select(card.alias("value")))
    return rows.select(cards.card_path().alias("path"), F.substring_index(cards.card_markdown(), "\n## ", 1).alias("head"))


@query(with_(LIVE) + "SELECT concept_id, title, description, status FROM l")
def src14_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader finds in the documents as they are rendered."""
    live = _live(spark, sf_dir)
    bodies = live.select("concept_id", F.lit("# Body").alias("body"))
    tags = live.withColumn("tags", F.from_json("tags", "array<string>")) if dict(live.dtypes)["tags"] == "string" else live
    rows = frontmatter.parsed(rendered(bodies, tags))
    front = F.from_json("front", "title string, description string, status string")
    return rows.select(tx.concept_of_path(F.col("path")).alias("concept_id"), front["title"].alias("title"), front["description"].alias("description"), front["status"].alias("status"))


@query("SELECT sha256(text) AS hash, CASE WHEN regexp_replace(text, '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+', '', 'g') = '' THEN 'empty' WHEN length(trim(text, ' ')) < 30 THEN 'empty' ELSE 'ok' END AS status FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0)) GROUP BY text")
def src7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of plain text: read from bytes, each content once."""
    rows = read_table(spark, sf_dir, "documents").filter("text IS NOT NULL AND NOT contains(text, '\\u0000')")
    files = rows.select(F.sha2("text", 256).alias("hash"), F.lit(".md").alias("ext"), F.lit("plain").alias("route"), F.encode("text", "utf-8").alias("content"))
    return extract.extract(files).select("hash", "status")


@query(with_(LIVE) + "SELECT concept_id, CASE WHEN concept_type = 'Runbook' THEN 'changed' ELSE 'same' END AS state FROM l WHERE concept_type <> 'Invoice' UNION ALL SELECT concept_id, 'gone' FROM l WHERE concept_type = 'Invoice'")
def set4_changed_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental index has to do where runbooks have new titles and invoices are gone."""
    before = _live(spark, sf_dir).select("concept_id", "concept_type", "title", "description")
    now = before.filter("concept_type <> 'Invoice'").withColumn("title", F.when(F.col("concept_type") == "Runbook", F.concat("title", F.lit(" (new)"))).otherwise(F.col("title")))
    fresh, stale = index.changed_concepts(index.fingerprints(now), index.fingerprints(before))
    gone = stale.join(fresh, "concept_id", "left_anti")
    mark = lambda rows, state: rows.select("concept_id", F.lit(state).alias("state"))
    return mark(fresh, "changed").unionByName(mark(gone, "gone")).unionByName(mark(before.join(stale, "concept_id", "left_anti"), "same"))
