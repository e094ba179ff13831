"""Queries over the file census and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, text
from ..operators import catalogue, manifest, reports
from ..session import read_table
from ..sources import routing
from .registry import query
from .sql import FILES, HASH, LIVE, RECORDS, with_

_ROUTE = "CASE WHEN lower(ext) = '.pdf' OR mime = 'application/pdf' THEN 'pdf' WHEN lower(ext) IN {0} THEN 'office' WHEN lower(ext) IN {1} THEN 'plain' WHEN lower(ext) IN {2} THEN 'skip' WHEN lower(ext) IN {3} THEN 'skip' ELSE 'skip' END".format(
    routing.OFFICE, routing.DOCUMENT_TEXT, routing.CODE_TEXT, routing.IMAGE
)
_DENY = ("*/Archive/*", "node_modules", "*.zip", "*.log", "*/glossary/*", "backup")
_INC = "scan_status = 'included' AND hash IS NOT NULL"


def _deny_sql() -> str:
    cases = []
    for g in _DENY:
        low = g.lower()
        if "/" in low:
            short = low.rstrip("/*")
            test = f"regexp_full_match(lower(path), '{globs.glob_regex(low)[1:-1]}')" + (f" OR regexp_full_match(lower(path), '{globs.glob_regex(short)[1:-1]}')" if short != low else "")
        else:
            test = f"len(list_filter(string_split(lower(path), '/'), lambda p: regexp_full_match(p, '{globs.glob_regex(low)[1:-1]}'))) > 0"
        cases.append(f"WHEN {test} THEN '{g}'")
    return "CASE " + " ".join(cases) + " END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.file_states(read_table(spark, sf_dir, "files"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.concept_records(read_table(spark, sf_dir, "concepts"))


@query(with_(FILES) + "SELECT path, scan_status, hash, last_seen FROM f")
def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", "scan_status", "hash", "last_seen")


@query(with_(FILES) + f", s AS (SELECT CASE WHEN {_deny_sql()} IS NOT NULL THEN 'denied' WHEN size > 5000 THEN 'too_large' WHEN {_ROUTE} = 'skip' THEN 'no_route' ELSE 'included' END AS outcome, size FROM f) SELECT outcome, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM s GROUP BY 1")
def src2_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = routing.scan_outcome(globs.denied_by(F.col("path"), _DENY), F.col("size"), F.col("ext"), F.col("mime"), 5000)
    return _files(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def src3_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("hash"))


_GROWN = "g AS (SELECT path, ext, scan_status, CASE WHEN touched THEN size + 1 ELSE size END AS size, CASE WHEN touched THEN NULL ELSE hash END AS hash, CASE WHEN touched THEN 'pending' ELSE coalesce(extract_status, 'pending') END AS extract_status FROM (SELECT *, scan_status = 'included' AND inode % 3 = 0 AS touched FROM f))"


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census after a scan that found every third included file a byte longer."""
    files = _files(spark, sf_dir)
    seen = files.filter("scan_status = 'included' AND inode % 3 = 0").select("path", "root", "ext", (F.col("size") + 1).alias("size"), "inode", "mtime", "mime", "scan_status")
    return manifest.upsert_stat(files, seen, "next", "2030-01-01T00:00:00+00:00")


@query(with_(FILES, _GROWN) + "SELECT path, size FROM g WHERE scan_status = 'included' AND hash IS NULL")
def src4_needs_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.needs_hash(_grown(spark, sf_dir)).select("path", "size")


@query(with_(FILES) + "SELECT ext, CASE " + " ".join(f"WHEN lower(ext) = '{e}' THEN '{t}'" for e, t in routing.TYPES.items()) + " END AS type, count(*) AS files FROM f GROUP BY ALL")
def src5_type_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy("ext", routing.type_by_extension(F.col("ext")).alias("type")).agg(F.count(F.lit(1)).alias("files"))


@query(with_(FILES) + f"SELECT path, {_ROUTE} AS route FROM f")
def src6_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", routing.route(F.col("ext"), F.col("mime")).alias("route"))


@query("SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text, CASE WHEN length(text) > 0 THEN round((length(text) - length(replace(text, chr(65533), ''))) / length(text), 6) ELSE 0.0 END AS lost FROM documents WHERE text IS NOT NULL")
def src8_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", text.normal_newlines(F.col("text")).alias("text"), F.round(text.replacement_share(F.col("text")), 6).alias("lost"))


_PAGES = r"""e AS (SELECT extract_path, min(text) AS text FROM extracts WHERE text IS NOT NULL GROUP BY 1),
p AS (SELECT extract_path, list_slice(regexp_split_to_array(text, '<!-- page \d+ -->'), 2, 100000) AS parts FROM e WHERE regexp_matches(text, '<!-- page \d+ -->')),
q AS (SELECT extract_path, len(parts) AS n, unnest(parts) AS t, generate_subscripts(parts, 1) - 1 AS page FROM p),
r AS (SELECT extract_path, n, page, length(regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')) < 400 AS thin FROM q),
s AS (SELECT DISTINCT extract_path, CAST(floor(i * n / least(n, 3)) AS BIGINT) AS page FROM (SELECT DISTINCT extract_path, n, unnest(range(CAST(least(n, 3) AS BIGINT))) AS i FROM r)) """


@query("WITH " + _PAGES + ", a AS (SELECT extract_path, count(*) AS pages, CAST(sum(thin::INT) AS BIGINT) AS thin_pages FROM r GROUP BY 1), b AS (SELECT extract_path, avg(thin::INT) AS share FROM r JOIN s USING (extract_path, page) GROUP BY 1) SELECT extract_path, pages, thin_pages, CASE WHEN share >= 0.6 THEN 'ocr' WHEN thin_pages > 0 THEN 'hybrid' ELSE 'text' END AS decision FROM a JOIN b USING (extract_path)")
def src9_page_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.page_decision(routing.page_texts(read_table(spark, sf_dir, "extracts")), thin_chars=400, sample=3)


@query(with_(FILES, _GROWN, "h AS (SELECT * REPLACE (coalesce(hash, md5(ext)) AS hash) FROM g)") + "SELECT hash, arg_min(path, path) AS path, arg_min(ext, path) AS ext, arg_min(size, path) AS size, count(*) AS copies FROM h WHERE scan_status = 'included' AND extract_status = 'pending' AND hash IS NOT NULL GROUP BY hash")
def src12_pending_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grown files, as if all of one ending were copies."""
    hashed = _grown(spark, sf_dir).withColumn("hash", F.coalesce("hash", F.md5("ext")))
    return manifest.pending_extractions(hashed).select("hash", "path", "ext", "size", "copies")


@query(with_(FILES) + r"SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1, 's') AS directory, regexp_replace(path, '^.*/', '', 's') AS name, strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM f")
def src18_file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd")
    return _files(spark, sf_dir).select("path", text.directory(F.col("path")).alias("directory"), text.base_name(F.col("path")).alias("name"), day.alias("day"))


@query(with_(FILES) + "SELECT path, path AS decoded FROM f")
def src20_uri_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", text.uri_path(text.file_uri(F.col("path"))).alias("decoded"))


@query(with_(FILES) + f"SELECT path, {_deny_sql()} AS denied_by FROM f")
def prj1_denied_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", globs.denied_by(F.col("path"), _DENY).alias("denied_by"))


@query(with_(FILES) + f"SELECT path, {_deny_sql()} IS NULL AND (path = '/vol/library/Projects' OR starts_with(path, '/vol/library/Projects/') OR starts_with(path, '/vol/shared/')) AND {_ROUTE} <> 'skip' AS in_scope FROM f")
def prj3_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = manifest.under(F.col("path"), F.lit("/vol/library/Projects")) | manifest.under(F.col("path"), F.lit("/vol/shared"))
    ok = globs.denied_by(F.col("path"), _DENY).isNull() & roots & (routing.route(F.col("ext"), F.col("mime")) != "skip")
    return _files(spark, sf_dir).select("path", ok.alias("in_scope"))


@query(with_(FILES) + "SELECT path, CASE WHEN regexp_full_match(path, '.*/Documents/.*', 's') THEN 'personal' WHEN regexp_full_match(path, '.*/Projects/.*', 's') THEN 'work' END AS sensitivity FROM f")
def prj6_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", globs.first_class(F.col("path"), (("personal", ("*/Documents/*",)), ("work", ("*/Projects/*",)))).alias("sensitivity"))


@query(with_(FILES) + "SELECT path, CASE WHEN starts_with(path, '/vol/library/') THEN '/vol/library' WHEN starts_with(path, '/vol/shared/') THEN '/vol/shared' ELSE '/vol' END AS root FROM f")
def prj22_root_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.coalesce(*[F.when(manifest.under(F.col("path"), F.lit(r)), r) for r in ("/vol/library", "/vol/shared")], F.lit("/vol"))
    return _files(spark, sf_dir).select("path", pick.alias("root"))


_ERR = "coalesce(nullif(error, ''), 'x')"


@query("SELECT DISTINCT error, CASE WHEN coalesce(error, '') = '' THEN 'unknown' ELSE left(regexp_replace(regexp_replace(regexp_replace(string_split(error, ' | ')[1], '/[^\\s''\"]*', '<path>', 'g'), '\\S*<path>\\S*(?:\\s+\\S*<path>\\S*)*', '<path>', 'g'), '\\d+', 'N', 'g'), 80) END AS error_class FROM files")
def prj14_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "files").select("error").distinct().select("error", text.error_class(F.col("error")).alias("error_class"))


@query(with_(FILES) + "SELECT hash, arg_min(path, path) AS path, arg_min(size, path) AS size, arg_min(ext, path) AS ext, count(*) AS copies FROM f WHERE " + _INC + " GROUP BY hash")
def agg1_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.representatives(_files(spark, sf_dir))


@query(with_(FILES) + "SELECT scan_status, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1")
def agg2_scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_status(_files(spark, sf_dir))


@query(with_(FILES) + "SELECT CASE WHEN coalesce(ext, '') = '' THEN '(none)' ELSE ext END AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM f WHERE scan_status = 'included' GROUP BY 1 ORDER BY files DESC, ext LIMIT 15")
def agg3_top_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_extensions(_files(spark, sf_dir))


@query(with_(FILES) + "SELECT root, count(*) AS n FROM f GROUP BY 1")
def agg4_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts_by(_files(spark, sf_dir), "root")


@query(with_(FILES) + f"SELECT count(*) AS files, count(DISTINCT hash) AS hashes, round(1 - count(DISTINCT hash) / count(*), 6) AS copied_share FROM f WHERE {_INC}")
def agg5_duplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.duplication(_files(spark, sf_dir))


@query(with_(FILES) + f"SELECT extract_status, count(*) AS hashes, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words FROM (SELECT DISTINCT hash, extract_status, word_count FROM f WHERE {_INC}) GROUP BY 1")
def agg6_extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.extraction_status(_files(spark, sf_dir))


@query(with_(FILES) + "SELECT CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words FROM (SELECT DISTINCT hash, word_count FROM f WHERE extract_status = 'ok' AND hash IS NOT NULL)")
def agg7_total_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.total_words(_files(spark, sf_dir))


@query(with_(FILES) + "SELECT extract_engine, count(DISTINCT hash) AS hashes, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words FROM f WHERE extract_status = 'ok' AND extract_engine IS NOT NULL GROUP BY 1")
def agg8_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.engines(_files(spark, sf_dir))


@query(with_(FILES) + ", x AS (SELECT ext, extract_status, CASE WHEN coalesce(error, '') = '' THEN 'unknown' ELSE left(regexp_replace(regexp_replace(regexp_replace(string_split(error, ' | ')[1], '/[^\\s''\"]*', '<path>', 'g'), '\\S*<path>\\S*(?:\\s+\\S*<path>\\S*)*', '<path>', 'g'), '\\d+', 'N', 'g'), 80) END AS error_class, path FROM f WHERE extract_status IN ('failed', 'empty', 'skipped')) SELECT ext, extract_status, error_class, count(*) AS files, min(path) AS example FROM x GROUP BY ALL ORDER BY files DESC, ext, extract_status, error_class LIMIT 20")
def agg9_failure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failure_groups(_files(spark, sf_dir))


@query(with_(FILES) + f", x AS (SELECT DISTINCT hash, extract_status FROM f WHERE {_INC}) SELECT CAST(sum((extract_status <> 'pending')::INT) AS BIGINT) AS attempted, CAST(sum((extract_status = 'ok')::INT) AS BIGINT) AS ok, round(sum((extract_status = 'ok')::INT) / sum((extract_status <> 'pending')::INT), 6) AS rate FROM x")
def agg10_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.success_rate(_files(spark, sf_dir))


@query(with_(FILES, RECORDS) + "SELECT count(*) - count(c.source_hash) AS pending FROM (SELECT DISTINCT hash FROM f WHERE scan_status = 'included' AND extract_status = 'ok' AND hash IS NOT NULL) h LEFT JOIN (SELECT source_hash FROM c WHERE enrich_status = 'ok') c ON h.hash = c.source_hash")
def agg22_pending_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.enrichable(_files(spark, sf_dir), _records(spark, sf_dir)).agg(F.count(F.lit(1)).alias("pending"))


@query(with_(FILES, RECORDS) + ", h AS (SELECT hash, min(path) AS path, max(last_seen) AS last_seen FROM f WHERE scan_status = 'included' AND extract_status = 'ok' AND hash IS NOT NULL GROUP BY 1) SELECT hash, path, last_seen, c.enrich_status FROM h LEFT JOIN c ON hash = source_hash WHERE coalesce(c.enrich_status, '') <> 'ok'")
def j1_enrichable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.enrichable(_files(spark, sf_dir), _records(spark, sf_dir))


@query(with_(FILES, RECORDS) + f", h AS (SELECT hash, min(path) AS path FROM f WHERE {_INC} GROUP BY 1) SELECT c.source_hash, concept_id, h.path FROM c JOIN h ON c.source_hash = h.hash WHERE enrich_status = 'ok'")
def j2_enriched_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.enriched_concepts(_files(spark, sf_dir), _records(spark, sf_dir)).select("source_hash", "concept_id", "path")


@query(with_(FILES, RECORDS) + f"SELECT source_hash, concept_id FROM c WHERE coalesce(status, 'stable') <> 'deprecated' AND NOT EXISTS (SELECT 1 FROM f WHERE {_INC} AND f.hash = c.source_hash)")
def j3_to_deprecate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.to_deprecate(_files(spark, sf_dir), _records(spark, sf_dir)).select("source_hash", "concept_id")


@query(with_(FILES, RECORDS) + f"SELECT source_hash, concept_id FROM c WHERE status = 'deprecated' AND EXISTS (SELECT 1 FROM f WHERE {_INC} AND f.hash = c.source_hash)")
def bnd5_to_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.to_restore(_files(spark, sf_dir), _records(spark, sf_dir)).select("source_hash", "concept_id")


@query(with_(FILES, LIVE) + "SELECT concept_id, min(path) AS path FROM l JOIN f ON source_hash = hash GROUP BY 1")
def j4_source_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = catalogue.live_concepts(read_table(spark, sf_dir, "concepts"))
    paths = _files(spark, sf_dir).select(F.col("hash").alias("source_hash"), "path")
    return live.join(paths, "source_hash").groupBy("concept_id").agg(F.min("path").alias("path"))


@query(with_(LIVE) + f", e AS (SELECT DISTINCT {HASH.format('hash')} AS h FROM extracts WHERE status = 'ok') SELECT concept_id FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE h = source_hash)")
def j5_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.orphans import normal_hash

    texts = read_table(spark, sf_dir, "extracts").filter("status = 'ok'").select(normal_hash(F.col("hash")).alias("source_hash")).dropna().distinct()
    return catalogue.live_concepts(read_table(spark, sf_dir, "concepts")).join(texts, "source_hash", "left_anti").select("concept_id")


_FIRST = FILES.replace("f AS (", "o AS (").replace("-epoch_us", "epoch_us")


def _first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest recorded state of each path, as a census before later scans."""
    rows = read_table(spark, sf_dir, "files").filter(F.col("path").isNotNull())
    order = F.struct(-catalogue.newest_first(F.col("last_seen")), F.col("hash"), F.col("scan_status"))
    first = rows.groupBy("path").agg(F.min_by(F.struct(*[F.col(c) for c in catalogue.FILE_COLUMNS]), order).alias("r")).select("r.*")
    from ..operators.orphans import normal_hash

    return first.withColumn("hash", normal_hash(F.col("hash")))


_SAME = "coalesce(o.size = z.size AND o.mtime = z.mtime AND o.inode = z.inode, false)"


@query(
    with_(FILES, _FIRST)
    + f""", z AS (SELECT path, CASE WHEN scan_status IN ('denied', 'unreadable') THEN 0 ELSE size END AS size, CASE WHEN scan_status IN ('denied', 'unreadable') THEN 0 ELSE inode END AS inode, CASE WHEN scan_status IN ('denied', 'unreadable') THEN 0 ELSE mtime END AS mtime FROM f)
SELECT coalesce(z.path, o.path) AS path, CASE WHEN z.path IS NULL THEN o.size ELSE z.size END AS size, CASE WHEN z.path IS NOT NULL AND NOT {_SAME} THEN NULL ELSE o.hash END AS hash,
 coalesce(CASE WHEN z.path IS NOT NULL AND NOT {_SAME} THEN NULL ELSE o.extract_status END, 'pending') AS extract_status, CASE WHEN z.path IS NULL THEN o.run_id ELSE 'r9' END AS run_id, coalesce(o.first_seen, '2026-01-01T00:00:00Z') AS first_seen
FROM o FULL JOIN z ON o.path = z.path"""
)
def man1_upsert_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.upsert_stat(_first_files(spark, sf_dir), _files(spark, sf_dir), "r9", "2026-01-01T00:00:00Z")
    return rows.select("path", "size", "hash", "extract_status", "run_id", "first_seen")


@query(with_(FILES) + "SELECT path, CASE WHEN starts_with(path, '/vol/library/Projects/') AND coalesce(run_id, '') <> 'r00000009' THEN 'missing' ELSE scan_status END AS scan_status FROM f")
def man2_mark_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.mark_missing(_files(spark, sf_dir), "r00000009", ["/vol/library/Projects"]).select("path", "scan_status")


@query(with_(RECORDS) + ", n AS (SELECT source_hash, concept_id || '-new' AS concept_id, upper(title) AS title FROM c) SELECT n.source_hash, coalesce(c.concept_id, n.concept_id) AS concept_id, n.title FROM n JOIN c USING (source_hash)")
def man3_save_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _records(spark, sf_dir)
    new = c.withColumn("concept_id", F.concat("concept_id", F.lit("-new"))).withColumn("title", F.upper("title"))
    return manifest.save_concepts(c, new).select("source_hash", "concept_id", "title")


@query(with_(FILES) + f", e AS (SELECT {HASH.format('hash')} AS h, min(status) AS status, max(word_count) AS words FROM extracts WHERE hash IS NOT NULL GROUP BY 1) SELECT path, coalesce(e.status, f.extract_status) AS extract_status, coalesce(CASE WHEN e.status IS NULL THEN f.word_count ELSE e.words END, 0) AS word_count FROM f LEFT JOIN e ON f.hash = e.h")
def man4_set_extract_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.orphans import normal_hash

    e = read_table(spark, sf_dir, "extracts").withColumn("hash", normal_hash(F.col("hash"))).filter("hash IS NOT NULL")
    e = e.groupBy("hash").agg(F.min("status").alias("status"), F.max("word_count").alias("word_count"), F.min("extract_path").alias("extract_path"), F.min("engine").alias("engine"), F.min("error").alias("error"))
    return manifest.set_extract_result(_files(spark, sf_dir), e).select("path", "extract_status", F.coalesce("word_count", F.lit(0)).alias("word_count"))


@query(with_(RECORDS) + "SELECT source_hash, concept_id FROM c WHERE concept_id IS NOT NULL")
def man7_taken_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).filter("concept_id IS NOT NULL").select("source_hash", "concept_id")


@query(with_(FILES, RECORDS) + ", h AS (SELECT hash, max(last_seen) AS last_seen FROM f WHERE scan_status = 'included' AND extract_status = 'ok' AND hash IS NOT NULL GROUP BY 1), p AS (SELECT hash, last_seen FROM h LEFT JOIN c ON hash = source_hash WHERE coalesce(c.enrich_status, '') <> 'ok') SELECT hash, row_number() OVER (ORDER BY last_seen DESC, hash) AS place FROM p ORDER BY last_seen DESC, hash LIMIT 200")
def w11_drain_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    top = manifest.enrichable(_files(spark, sf_dir), _records(spark, sf_dir)).orderBy(F.desc("last_seen"), "hash").limit(200)
    return top.select("hash", F.row_number().over(Window.orderBy(F.desc("last_seen"), "hash")).cast("bigint").alias("place"))
