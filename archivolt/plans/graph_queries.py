"""Queries over the bundle and the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bundle, catalogue, graph
from ..session import read_table
from .registry import ORACLES, query
from .sql import FILES, LIVE, MENTIONS, RECORDS, TAGS, TERMS, with_

_REAL = MENTIONS + f", r AS (SELECT * FROM m WHERE NOT (regexp_matches(trim(name), '^(https?://|www\\.)', 'i') OR regexp_matches(trim(name), '{tx.FILE_EXTENSIONS}', 'i') OR (regexp_matches(trim(name), '{tx.SCRIPT_EXTENSIONS}', 'i') AND NOT regexp_matches(regexp_replace(trim(name), '{tx.SCRIPT_EXTENSIONS}', '', 'i'), '^\\p{{Lu}}[\\p{{L}}\\p{{N}}]*$'))))"
_STEP = r"/(?:[^/.][^/]*|\.[^/.][^/]*|\.\.[^/]+)/\.\.(/|$)"
_LINKS = rf"""cleaned AS (SELECT from_id, target, regexp_replace(target, '[#?].*$', '', 's') AS plain FROM links_to),
body AS (SELECT DISTINCT from_id, CASE WHEN starts_with(plain, '/') THEN regexp_replace(left(plain, length(plain) - 3), '^/+', '') ELSE regexp_extract(from_id, '^(.*)/[^/]*$', 1) || '/' || left(plain, length(plain) - 3) END AS p FROM cleaned
  WHERE NOT regexp_matches(target, '^(http://|https://|mailto:|file://|#)') AND ends_with(plain, '.md')),
tidy AS (SELECT from_id, array_to_string(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.'), '/') AS q, 0 AS depth FROM body
  UNION ALL SELECT from_id, ltrim(regexp_replace('/' || q, '{_STEP}', '\1'), '/'), depth + 1 FROM tidy WHERE regexp_matches('/' || q, '{_STEP}') AND depth < 64),
e AS (SELECT DISTINCT from_id, trim(q, '/') AS to_id FROM tidy WHERE NOT regexp_matches('/' || q, '{_STEP}') AND from_id <> trim(q, '/') AND from_id IN (SELECT concept_id FROM l)),
k AS (SELECT * FROM e WHERE to_id IN (SELECT concept_id FROM l)), u AS (SELECT from_id AS a, to_id AS b FROM k UNION SELECT to_id, from_id FROM k)"""


def _graph_sql(*parts: str) -> str:
    return with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "concepts")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.live_concepts(_concepts(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.file_states(read_table(spark, sf_dir, "files"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.link_edges(read_table(spark, sf_dir, "links_to"), _concepts(spark, sf_dir))


@query(with_(LIVE) + r"SELECT concept_id, concept_type AS type, title, sensitivity, source_hash, regexp_extract(concept_id, '^(.*)/[^/]*$', 1) AS directory FROM l")
def gr1_concept_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.concept_nodes(_concepts(spark, sf_dir)).select("concept_id", "type", "title", "sensitivity", "source_hash", "directory")


@query(with_(FILES, LIVE) + "SELECT hash, min(path) AS path, arg_min(ext, path) AS ext, arg_min(size, path) AS size FROM f WHERE hash IN (SELECT source_hash FROM l) GROUP BY 1")
def gr2_file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_nodes(_files(spark, sf_dir), _concepts(spark, sf_dir)).select("hash", "path", "ext", "size")


@query(with_(LIVE, _REAL) + "SELECT key, min(kind) AS kind, arg_min(name, concept_id || chr(1) || name) AS name, count(*) AS occurrence_count, count(DISTINCT concept_id) AS documents, strftime(min(CAST(generated_at AS TIMESTAMPTZ)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS first_seen FROM r JOIN l USING (concept_id) GROUP BY 1")
def gr3_entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.entity_nodes(_concepts(spark, sf_dir))
    return rows.select("key", "kind", "name", "occurrence_count", "documents", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query(with_(LIVE, TAGS) + "SELECT tag, count(*) AS concept_count FROM t GROUP BY 1")
def gr4_tag_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tag_nodes(_concepts(spark, sf_dir))


@query(_graph_sql(LIVE, _LINKS) + "SELECT from_id, to_id FROM k")
def gr5_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


@query(_graph_sql(LIVE, _LINKS) + "SELECT from_id, to_id FROM e WHERE to_id NOT IN (SELECT concept_id FROM l)")
def gr6_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.broken_links(read_table(spark, sf_dir, "links_to"), _concepts(spark, sf_dir))


_IDS = "i AS (SELECT concept_id AS id FROM l UNION SELECT regexp_extract(concept_id, '^(.*)/[^/]*$', 1) FROM l)"


@query(with_(LIVE, _IDS) + "SELECT a.id AS child, arg_max(b.id, length(b.id)) AS parent FROM i a JOIN i b ON starts_with(a.id, b.id || '/') GROUP BY 1")
def gr7_child_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _live(spark, sf_dir).select("concept_id")
    return graph.child_edges(ids.union(ids.select(tx.directory(F.col("concept_id")))).distinct())


@query(with_(FILES, LIVE) + "SELECT concept_id, source_hash AS hash FROM l WHERE source_hash IN (SELECT hash FROM f WHERE hash IS NOT NULL)")
def gr8_derived_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.derived_edges(_files(spark, sf_dir), _concepts(spark, sf_dir))


@query(with_(LIVE, _REAL) + "SELECT DISTINCT concept_id, key FROM r")
def gr8_mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mention_edges(_concepts(spark, sf_dir))


@query(with_(LIVE, TAGS) + "SELECT DISTINCT concept_id, tag FROM t")
def gr8_tag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tag_edges(_concepts(spark, sf_dir))


@query(
    r"""WITH n AS (SELECT DISTINCT key, kind, name, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^\p{L}\p{N}_]+'), lambda t: t <> '')) AS w, regexp_matches(trim(name), '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS mail FROM entities WHERE key IS NOT NULL AND name IS NOT NULL),
c AS (SELECT a.key AS a, b.key AS b, 'contained' AS reason FROM n a JOIN n b ON a.kind = b.kind AND a.key <> b.key AND NOT a.mail AND NOT b.mail AND len(a.w) < len(b.w) AND list_has_all(b.w, a.w) AND len(a.w) > 0),
q AS (SELECT kind, key AS a, unnest(list_filter(regexp_split_to_array(lower(regexp_extract(name, '^([^@]+)@', 1)), '[^\p{L}\p{N}_]+'), lambda t: t <> '')) AS part FROM n WHERE mail),
p AS (SELECT kind, key AS b, w, unnest(w) AS x FROM n WHERE NOT mail),
s AS (SELECT kind, b, x AS part FROM p UNION SELECT kind, b, left(list_sort(list_filter(w, lambda y: y <> x))[1], 1) || x FROM p WHERE length(x) > 2 AND len(w) > 1),
m AS (SELECT DISTINCT a, b, 'email' AS reason FROM q JOIN s USING (kind, part))
SELECT DISTINCT least(a, b) AS key_a, greatest(a, b) AS key_b, reason FROM (SELECT * FROM c UNION ALL SELECT * FROM m)"""
)
def gr9_duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read_table(spark, sf_dir, "entities").filter("key IS NOT NULL AND name IS NOT NULL").select("key", "name", "kind")
    return graph.duplicate_candidates(nodes)


@query(with_(LIVE, _REAL) + ", d AS (SELECT DISTINCT concept_id, key FROM r) SELECT a.key AS key_a, b.key AS key_b, count(*) AS together FROM d a JOIN d b USING (concept_id) WHERE a.key < b.key GROUP BY ALL")
def j9_co_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.co_occurrences(graph.mention_edges(_concepts(spark, sf_dir)))


@query(with_(LIVE, _REAL) + "SELECT key, count(*) AS occurrence_count FROM (SELECT concept_id, coalesce(x.to_key, r.key) AS key FROM r LEFT JOIN (SELECT a.key AS from_key, min(b.key) AS to_key FROM (SELECT DISTINCT key, name FROM entities) a JOIN (SELECT DISTINCT key, name FROM entities) b ON lower(a.name) || ' project' = lower(b.name) GROUP BY 1) x ON r.key = x.from_key) GROUP BY 1")
def j13_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "entities").select("key", "name").distinct()
    other = e.select(F.col("key").alias("to_key"), F.lower("name").alias("n"))
    aliases = e.join(other, F.concat(F.lower("name"), F.lit(" project")) == F.col("n")).groupBy(F.col("key").alias("alias_key")).agg(F.min("to_key").alias("key"))
    return graph.mentions(_concepts(spark, sf_dir), aliases).groupBy("key").agg(F.count(F.lit(1)).alias("occurrence_count"))


_SEED = ", s AS (SELECT concept_id FROM l WHERE concept_type = 'Runbook')"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).filter("concept_type = 'Runbook'").select(F.lit(1).alias("qid"), "concept_id")


@query(_graph_sql(LIVE, _LINKS) + _SEED + " SELECT DISTINCT b AS concept_id FROM u WHERE a IN (SELECT * FROM s) AND b NOT IN (SELECT * FROM s)")
def gr11_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_links(spark, sf_dir), _seeds(spark, sf_dir)).select("concept_id")


@query(_graph_sql(LIVE, _LINKS) + _SEED + ", h AS (SELECT DISTINCT b FROM u WHERE a IN (SELECT * FROM s)), g AS (SELECT b FROM h UNION SELECT u.b FROM u JOIN h ON u.a = h.b) SELECT b AS concept_id FROM g WHERE b NOT IN (SELECT * FROM s)")
def gr12_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_links(spark, sf_dir), _seeds(spark, sf_dir), 2).select("concept_id")


_START = "(SELECT min(concept_id) FROM l)"


def _start(spark: SparkSession, sf_dir: str) -> str:
    return _live(spark, sf_dir).agg(F.min("concept_id")).first()[0] or ""


@query(with_(LIVE, _REAL) + f", d AS (SELECT DISTINCT concept_id, key FROM r) SELECT b.concept_id, b.key AS via FROM d a JOIN d b USING (key) WHERE a.concept_id = {_START} AND b.concept_id <> {_START}")
def gr13_shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shared_neighbours(graph.mention_edges(_concepts(spark, sf_dir)), _start(spark, sf_dir))


@query(
    _graph_sql(LIVE, _REAL, TAGS, _LINKS)
    + f", z AS (SELECT b AS concept_id, 'LINKS_TO' AS reason FROM u WHERE a = {_START} AND b <> {_START} UNION SELECT y.concept_id, 'MENTIONS:' || y.key FROM r x JOIN r y USING (key) WHERE x.concept_id = {_START} AND y.concept_id <> {_START} UNION SELECT y.concept_id, 'TAGGED_AS:' || y.tag FROM t x JOIN t y USING (tag) WHERE x.concept_id = {_START} AND y.concept_id <> {_START}) SELECT concept_id, list_sort(list(DISTINCT reason)) AS reasons FROM z GROUP BY 1 ORDER BY len(list(DISTINCT reason)) DESC, concept_id LIMIT 50"
)
def gr14_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"MENTIONS": graph.mention_edges(_concepts(spark, sf_dir)), "TAGGED_AS": graph.tag_edges(_concepts(spark, sf_dir))}
    return graph.traverse(_start(spark, sf_dir), _links(spark, sf_dir), named)


@query(with_(LIVE, TAGS, MENTIONS, TERMS) + ", d AS (SELECT term, count(DISTINCT concept_id) AS df FROM w GROUP BY 1) SELECT term, df, round(1 / log2(df + 1), 6) AS rarity FROM d")
def agg13_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.link_terms(_live(spark, sf_dir)).groupBy("term").agg(F.countDistinct("concept_id").alias("df"))
    return rows.withColumn("rarity", F.round(1 / F.log2(F.col("df") + 1), 6))


@query(
    with_(LIVE, TAGS, MENTIONS, TERMS)
    + """, d AS (SELECT term, count(DISTINCT concept_id) AS df FROM w GROUP BY 1 HAVING count(DISTINCT concept_id) BETWEEN 2 AND 60), p AS (SELECT concept_id, term, CAST(CAST(weight AS DOUBLE) / log2(df + 1) AS DECIMAL(18, 9)) AS part FROM w JOIN d USING (term)),
s AS (SELECT a.concept_id, b.concept_id AS peer, CAST(sum(a.part) AS DOUBLE) AS score FROM p a JOIN p b USING (term) WHERE a.concept_id <> b.concept_id GROUP BY ALL) SELECT concept_id, peer, round(score, 6) AS score, row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, peer) AS place FROM s WHERE score >= 0.35 QUALIFY place <= 8"""
)
def bnd1_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.related(_live(spark, sf_dir)).withColumn("place", F.col("place").cast("bigint"))


@query(with_(RECORDS) + "SELECT source_hash, coalesce(nullif(concept_type, ''), 'Other') AS concept_type, coalesce(nullif(sensitivity, ''), 'personal') AS sensitivity, coalesce(nullif(status, ''), 'stable') AS status FROM c")
def bnd2_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.concept_records(_concepts(spark, sf_dir))
    value = lambda c, d: F.coalesce(F.expr(f"nullif({c}, '')"), F.lit(d)).alias(c)
    return rows.select("source_hash", value("concept_type", "Other"), value("sensitivity", "personal"), value("status", "stable"))


@query(
    with_(LIVE)
    + r""", n AS (SELECT source_hash, regexp_replace(regexp_replace(lower(concept_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '/' || regexp_replace(regexp_replace(lower(split_part(title, ' ', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS want FROM l),
t AS (SELECT source_hash, want, unnest([want, want || '-' || left(source_hash, 6), want || '-' || left(source_hash, 10), want || '-' || left(source_hash, 16), want || '-' || source_hash]) AS name, unnest([0, 1, 2, 3, 4]) AS n FROM n),
t2 AS (SELECT * FROM t WHERE name NOT IN (SELECT want FROM n JOIN l USING (source_hash) WHERE concept_type = 'Runbook')),
f AS (SELECT name, min(source_hash) AS source_hash, count(*) AS wanted FROM t2 GROUP BY 1), v AS (SELECT t.source_hash, t.name, t.n FROM t2 t JOIN f ON t.name = f.name AND t.source_hash = f.source_hash WHERE t.n = 0 OR f.wanted = 1 OR t.n = 4)
SELECT source_hash, arg_min(name, n) AS concept_id FROM v GROUP BY 1"""
)
def f3_allocate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _live(spark, sf_dir).select("source_hash", "concept_type", F.split("title", " ")[0].alias("title"))
    # the ids that runbooks would get are taken, so that these and all that want the same get a suffix
    slug = lambda c: tx.slugify(F.col(c))
    taken = new.filter("concept_type = 'Runbook'").select(F.concat(slug("concept_type"), F.lit("/"), slug("title")).alias("concept_id"))
    return bundle.allocate_ids(new, taken)


@query(
    with_(LIVE)
    + r""", r AS (SELECT regexp_extract(concept_id, '^(.*)/[^/]*$', 1) AS directory, concept_id, coalesce(title, '') AS title, coalesce(description, '') AS d FROM l)
SELECT directory, count(*) AS entries, string_agg('* [' || title || '](/' || concept_id || '.md)' || CASE WHEN d <> '' THEN ' - ' || d ELSE '' END, chr(10) ORDER BY replace(lower(title), 'ß', 'ss'), concept_id) AS body FROM r GROUP BY 1"""
)
def snk5_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.indexes(_live(spark, sf_dir))


@query("WITH e AS (SELECT strftime(CAST(started_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, run_id, command || ' ' || run_id AS line FROM (SELECT DISTINCT run_id, command, started_at FROM runs)), d AS (SELECT day, string_agg(line, chr(10) ORDER BY run_id DESC) AS lines FROM e GROUP BY 1) SELECT string_agg('## ' || day || chr(10) || lines, chr(10) || chr(10) ORDER BY day DESC) AS body FROM d")
def snk6_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read_table(spark, sf_dir, "runs").select("run_id", "command", "started_at").distinct()
    return bundle.log_text(runs.select(F.date_format(F.try_to_timestamp("started_at"), "yyyy-MM-dd").alias("day"), F.col("run_id").alias("seq"), F.concat_ws(" ", "command", "run_id").alias("line")))


@query(with_(RECORDS) + ", i AS (SELECT concept_id FROM c WHERE concept_id IS NOT NULL), o AS (SELECT concept_id AS id FROM i UNION SELECT concept_id || '-draft' FROM i UNION SELECT regexp_extract(concept_id, '^(.*)/[^/]*$', 1) || '/index' FROM i) SELECT id AS concept_id FROM o WHERE id NOT IN (SELECT concept_id FROM i) AND NOT ends_with(id, '/index')")
def set7_orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On disk are the concepts' documents, a draft of each, and the directories' indexes: the drafts are orphans."""
    c = catalogue.concept_records(_concepts(spark, sf_dir)).filter("concept_id IS NOT NULL")
    ids = F.array("concept_id", F.concat("concept_id", F.lit("-draft")), F.concat(tx.directory(F.col("concept_id")), F.lit("/index")))
    on_disk = c.select(F.explode(ids).alias("concept_id"))
    return bundle.orphan_files(on_disk, c.filter("coalesce(status, 'stable') <> 'deprecated'"), c.filter("status = 'deprecated'"))


@query(with_(RECORDS) + ", n AS (SELECT concept_id FROM c WHERE concept_id IS NOT NULL AND (written_at IS NULL OR TRY_CAST(written_at AS TIMESTAMPTZ) < TRY_CAST(generated_at AS TIMESTAMPTZ))) SELECT concept_id FROM n UNION SELECT concept_id FROM c WHERE status = 'deprecated' AND concept_id IS NOT NULL")
def set4_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalogue.concept_records(_concepts(spark, sf_dir)).filter("concept_id IS NOT NULL")
    stale = F.col("written_at").isNull() | (F.try_to_timestamp("written_at") < F.try_to_timestamp("generated_at"))
    return c.filter(stale).select("concept_id").union(c.filter("status = 'deprecated'").select("concept_id")).distinct()


@query(with_(LIVE, TAGS) + ", g AS (SELECT concept_id, list_sort(list(DISTINCT tag)) AS tags FROM t GROUP BY 1), p AS (SELECT DISTINCT a.concept_id AS a, b.concept_id AS b FROM t a JOIN t b USING (tag) WHERE a.concept_id < b.concept_id) SELECT a, b, list_slice(list_sort(list_filter(x.tags, lambda v: list_contains(y.tags, v))), 1, 3) AS shared FROM p JOIN g x ON x.concept_id = a JOIN g y ON y.concept_id = b")
def set5_shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.sharing_pairs(catalogue.concept_tags(_live(spark, sf_dir)), "tag")


@query(_graph_sql(FILES, LIVE, _REAL, TAGS, _LINKS) + "SELECT 'Concept' AS label, count(*) AS n FROM l UNION ALL SELECT 'Entity', count(DISTINCT key) FROM r UNION ALL SELECT 'Tag', count(DISTINCT tag) FROM t UNION ALL SELECT 'File', count(DISTINCT hash) FROM f WHERE hash IN (SELECT source_hash FROM l) UNION ALL SELECT 'LINKS_TO', count(*) FROM k UNION ALL SELECT 'MENTIONS', count(*) FROM (SELECT DISTINCT concept_id, key FROM r) UNION ALL SELECT 'TAGGED_AS', count(*) FROM (SELECT DISTINCT concept_id, tag FROM t)")
def agg16_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _concepts(spark, sf_dir), F.count(F.lit(1)).alias("n")
    parts = {"Concept": graph.concept_nodes(c), "Entity": graph.mentions(c).select("key").distinct(), "Tag": graph.tag_nodes(c), "File": graph.file_nodes(_files(spark, sf_dir), c), "LINKS_TO": _links(spark, sf_dir), "MENTIONS": graph.mention_edges(c), "TAGGED_AS": graph.tag_edges(c)}
    out = None
    for label, rows in parts.items():
        one = rows.agg(n).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_BODIES = r"""u AS (SELECT hash AS source_hash, min(path) AS path FROM f WHERE hash IS NOT NULL GROUP BY 1),
en AS (SELECT concept_id, string_agg('- ' || x, chr(10) ORDER BY i) AS ents FROM (SELECT concept_id, x, min(i) AS i FROM (SELECT concept_id, i, (e ->> 'name') || ' (' || (e ->> 'kind') || ')' AS x FROM (SELECT concept_id, unnest(CAST(json_extract(entities, '$[*]') AS JSON[])) AS e, generate_subscripts(CAST(json_extract(entities, '$[*]') AS JSON[]), 1) AS i FROM l WHERE entities IS NOT NULL)) WHERE x IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
li AS (SELECT b.concept_id, string_agg('- [' || coalesce(l.title, peer) || '](/' || peer || '.md)', chr(10) ORDER BY place) AS peers FROM bnd b JOIN l ON l.concept_id = peer GROUP BY 1)"""


@query("WITH bnd AS (" + ORACLES["bnd1_related"] + "), " + with_(FILES, LIVE, _BODIES).removeprefix("WITH ") + r"""SELECT l.concept_id, '# Summary' || chr(10) || chr(10) || coalesce(description, '') || chr(10) || chr(10) || '# Source' || chr(10) || chr(10) || coalesce('file://' || replace(replace(replace(url_encode(path), '%2F', '/'), '~', '%7E'), '%2A', '*'), 'unknown') || chr(10) || chr(10) || '# Entities' || chr(10) || chr(10) || coalesce(ents, '- None.') || chr(10) || chr(10) || '# Related' || chr(10) || chr(10) || coalesce(peers, '- None.') AS body FROM l LEFT JOIN u USING (source_hash) LEFT JOIN en USING (concept_id) LEFT JOIN li USING (concept_id)""")
def snk4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _live(spark, sf_dir)
    paths = _files(spark, sf_dir).filter("hash IS NOT NULL").groupBy(F.col("hash").alias("source_hash")).agg(F.min("path").alias("path"))
    return bundle.documents(live, paths, bundle.related(live))


@query(with_(LIVE) + "SELECT 'warning' AS level, concept_id || '.md' AS path, 'it should have `' || key || '`' AS message FROM (SELECT concept_id, unnest(['title', 'description']) AS key, unnest([title, description]) AS value FROM l WHERE coalesce(concept_type, '') <> '') WHERE trim(coalesce(value, '')) = '' UNION ALL SELECT 'error', concept_id || '.md', 'the frontmatter names no `type`' FROM l WHERE coalesce(concept_type, '') = ''")
def val1_validate_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.bundles import rendered

    return bundle.validate(rendered(snk4_documents(spark, sf_dir), _live(spark, sf_dir)))


@query(with_(LIVE) + "SELECT 'warning' AS level, 'it should have `...`' AS finding, count(*) AS n, min(concept_id || '.md') AS example FROM (SELECT concept_id, unnest([title, description]) AS value FROM l WHERE coalesce(concept_type, '') <> '') WHERE trim(coalesce(value, '')) = '' HAVING count(*) > 0")
def agg21_finding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = val1_validate_bundle(spark, sf_dir)
    return rows.groupBy("level", tx.masked_finding(F.col("message")).alias("finding")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("example"))
