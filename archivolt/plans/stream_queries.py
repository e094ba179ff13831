"""Queries over changes and the graph language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, cypher, graph, manifest
from ..session import read_table
from ..sources import routing
from ..streaming import changes
from .graph_queries import _LINKS, _REAL, _graph_sql
from .manifest_queries import _FIRST, _ROUTE, _first_files
from .registry import query
from .sql import FILES, LIVE, TAGS, with_


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("path"), "ts", F.when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("event"))


@query("SELECT CAST(user_id AS VARCHAR) AS path, arg_max(CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'modified' END, (ts, event_id)) AS event, CAST(epoch_us(max(ts)) AS BIGINT) AS us FROM events GROUP BY 1")
def st1_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.last_events(_events(spark, sf_dir)).select("path", "event", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


_BURSTS = "WITH g AS (SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(ts) AS us FROM events), n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY path ORDER BY us) <= 600000000 THEN 0 ELSE 1 END AS fresh FROM g), b AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY us) AS burst FROM n) SELECT path, min(us) AS first_us, max(us) AS last_us, count(*) AS events FROM b GROUP BY path, burst"


@query(_BURSTS)
def st2_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.settled_sessions(_events(spark, sf_dir), 600)
    return rows.select("path", *[F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us") for c in ("first", "last")], "events")


@query(_BURSTS)
def st2_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.session_bursts(_events(spark, sf_dir), "600 seconds")
    return rows.select("path", *[F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us") for c in ("first", "last")], "events")


@query(with_(FILES, _FIRST) + f", h AS (SELECT DISTINCT hash FROM o WHERE hash IS NOT NULL) SELECT f.path, CASE WHEN f.scan_status = 'missing' THEN 'deleted' WHEN {_ROUTE.replace('ext)', 'f.ext)').replace('mime =', 'f.mime =')} = 'skip' THEN 'ignored' WHEN f.size > 5000 THEN 'too_large' WHEN o.size = f.size AND o.mtime = f.mtime THEN 'unchanged' WHEN f.hash IS NULL THEN 'unreadable' WHEN f.hash IN (SELECT hash FROM h) THEN 'known_hash' ELSE 'extract' END AS outcome FROM f LEFT JOIN o ON o.path = f.path")
def st5_change_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, before = catalogue.file_states(read_table(spark, sf_dir, "files")), _first_files(spark, sf_dir)
    seen = files.select("path", F.when(F.col("scan_status") == "missing", "deleted").otherwise("modified").alias("event"), routing.route(F.col("ext"), F.col("mime")).alias("route"), "size", "mtime", "hash")
    return changes.change_outcomes(seen, before, before.select("hash"), 5000)


def _graph(spark: SparkSession, sf_dir: str) -> cypher.Graph:
    c = read_table(spark, sf_dir, "concepts")
    states = catalogue.file_states(read_table(spark, sf_dir, "files"))
    files, derived = graph.file_nodes(states, c), graph.derived_edges(states, c)
    edge = lambda rows, a, b: rows.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"))
    nodes = {"Concept": (graph.concept_nodes(c), "concept_id"), "Entity": (graph.mentions(c).groupBy("key").agg(F.min("name").alias("name"), F.min("kind").alias("kind")), "key"), "Tag": (graph.tag_nodes(c), "tag"), "File": (files, "hash")}
    edges = {"LINKS_TO": (graph.link_edges(read_table(spark, sf_dir, "links_to"), c), "Concept", "Concept"), "MENTIONS": (edge(graph.mention_edges(c), "concept_id", "key"), "Concept", "Entity"), "TAGGED_AS": (edge(graph.tag_edges(c), "concept_id", "tag"), "Concept", "Tag")}
    edges["CHILD_OF"] = (edge(graph.child_edges(graph.concept_nodes(c)), "child", "parent"), "Concept", "Concept")
    edges["DERIVED_FROM"] = (derived.toDF("from_id", "to_id"), "Concept", "File")
    return cypher.Graph(nodes, edges)


@query(with_(LIVE, _REAL) + "SELECT min(name) AS person, count(DISTINCT concept_id) AS docs FROM r WHERE kind = 'person' GROUP BY key ORDER BY docs DESC, person LIMIT 15")
def gr16_who_appears_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cypher.run(_graph(spark, sf_dir), "MATCH (c:Concept)-[:MENTIONS]->(e:Entity) WHERE e.kind = 'person' RETURN e.name AS person, count(DISTINCT c) AS docs ORDER BY docs DESC LIMIT 15")


@query(with_(LIVE, _REAL) + ", d AS (SELECT DISTINCT concept_id, key FROM r WHERE kind = 'organization'), n AS (SELECT key, min(name) AS name FROM r GROUP BY 1) SELECT DISTINCT x.concept_id AS a, y.concept_id AS b, n.name AS org FROM d x JOIN d y USING (key) JOIN n USING (key) WHERE x.concept_id < y.concept_id ORDER BY a, b, org LIMIT 20")
def gr17_shared_organization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cypher.run(_graph(spark, sf_dir), "MATCH (a:Concept)-[:MENTIONS]->(e:Entity)<-[:MENTIONS]-(b:Concept) WHERE e.kind = 'organization' AND a.concept_id < b.concept_id RETURN DISTINCT a.concept_id AS a, b.concept_id AS b, e.name AS org ORDER BY a LIMIT 20")


@query(with_(LIVE, _REAL, TAGS) + ", d AS (SELECT DISTINCT concept_id, key FROM r), g AS (SELECT DISTINCT concept_id, tag FROM t) SELECT tag, count(DISTINCT g.concept_id) AS docs, count(DISTINCT key) AS entities FROM g JOIN d USING (concept_id) GROUP BY 1")
def gr18_tags_and_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cypher.run(_graph(spark, sf_dir), "MATCH (t:Tag)<-[:TAGGED_AS]-(c:Concept)-[:MENTIONS]->(e:Entity) RETURN t.tag AS tag, count(DISTINCT c) AS docs, count(DISTINCT e) AS entities")


@query(_graph_sql(LIVE, _LINKS) + ", s AS (SELECT concept_id FROM l WHERE concept_type = 'Runbook'), h AS (SELECT DISTINCT s.concept_id AS a, b FROM u JOIN s ON u.a = s.concept_id), g AS (SELECT a, b FROM h UNION SELECT h.a, u.b FROM h JOIN u ON h.b = u.a) SELECT DISTINCT a AS start, b AS reached FROM g WHERE a <> b")
def gr15_variable_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cypher.run(_graph(spark, sf_dir), "MATCH (a:Concept)-[:LINKS_TO*1..2]-(b:Concept) WHERE a.type = 'Runbook' AND a.concept_id <> b.concept_id RETURN DISTINCT a.concept_id AS start, b.concept_id AS reached")


@query(with_(FILES, LIVE, _REAL, TAGS) + "SELECT (SELECT count(*) FROM l) + (SELECT count(DISTINCT key) FROM r) + (SELECT count(DISTINCT tag) FROM t) + (SELECT count(DISTINCT hash) FROM f WHERE hash IN (SELECT source_hash FROM l)) AS nodes")
def gr15_count_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cypher.run(_graph(spark, sf_dir), "MATCH (n) RETURN count(n) AS nodes")


@query(with_(LIVE) + "SELECT concept_id AS id FROM l WHERE (concept_type = 'Runbook' OR concept_type = 'Invoice') AND NOT contains(title, 'the') AND starts_with(sensitivity, 'w')")
def gr15_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cypher.run(_graph(spark, sf_dir), "MATCH (c:Concept) WHERE (c.type = 'Runbook' OR c.type = 'Invoice') AND NOT c.title CONTAINS 'the' AND c.sensitivity STARTS WITH 'w' RETURN c.concept_id AS id")


@query(with_(FILES, LIVE) + "SELECT concept_id AS id, count(DISTINCT f.hash) AS files FROM l LEFT JOIN f ON f.hash = l.source_hash GROUP BY 1")
def gr15_optional_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cypher.run(_graph(spark, sf_dir), "MATCH (c:Concept) OPTIONAL MATCH (c)-[:DERIVED_FROM]->(f:File) RETURN c.concept_id AS id, count(DISTINCT f) AS files")


@query(with_(LIVE, TAGS) + ", d AS (SELECT DISTINCT concept_id, tag FROM t), n AS (SELECT tag, count(DISTINCT concept_id) AS docs FROM d GROUP BY 1) SELECT docs, count(*) AS tags, list_sort(list(tag)) AS named FROM n WHERE docs > 3 GROUP BY 1")
def gr15_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cypher.run(_graph(spark, sf_dir), "MATCH (c:Concept)-[:TAGGED_AS]->(t:Tag) WITH t.tag AS tag, count(DISTINCT c) AS docs WHERE docs > 3 RETURN docs, count(tag) AS tags, collect(tag) AS named")


@query(with_(FILES) + "SELECT path FROM f WHERE path = '/vol/shared' OR starts_with(path, '/vol/shared/')")
def prj22_under_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.file_states(read_table(spark, sf_dir, "files")).filter(manifest.under(F.col("path"), F.lit("/vol/shared"))).select("path")
