"""Queries that search: keyword and vector rankings, fusion, grouping, evaluation.

The questions are the titles of the runbooks; a question's vector is that of the
runbook's first usable chunk, and is compared with the vectors of its model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalogue, evaluation, graph, index, retrieval
from ..session import cut, read_table
from .graph_queries import _LINKS, _graph_sql
from .registry import query
from .sql import CHUNKS, LIVE, with_

_V = "v AS (SELECT chunk_id, model, min(vector) AS vector FROM chunks JOIN embedders USING (model) WHERE len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1, 2)"
_Q = "q AS (SELECT concept_id AS qid, title AS q FROM l WHERE concept_type = 'Runbook')"
_QV = "qv AS (SELECT qid, v.model, vector AS qvec FROM q JOIN k ON k.concept_id = qid JOIN v USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY chunk_index, v.model) = 1)"
_BM = r"""qt AS (SELECT qid, term, count(*) AS weight FROM (SELECT qid, unnest(regexp_extract_all(lower(x), '[\p{L}\p{N}]+')) AS term FROM (SELECT qid, unnest(list_filter(regexp_split_to_array(regexp_replace(q, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda t: length(t) > 1)) AS x FROM q)) GROUP BY ALL),
ct AS (SELECT chunk_id, regexp_extract_all(lower(title || ' ' || coalesce(heading_path, '') || ' ' || text), '[\p{L}\p{N}]+') AS terms FROM k),
st AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM ct), po AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM ct) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
bs AS (SELECT qid, chunk_id, round(sum(greatest(ln((n - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len(terms) / mean)) * weight), 6) AS score FROM qt JOIN po USING (term) JOIN df USING (term) JOIN ct USING (chunk_id), st GROUP BY ALL),
br AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM bs QUALIFY rank <= 50)"""
_VR = "vs AS (SELECT qid, chunk_id, round(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(qvec AS DOUBLE[])), 6) AS score FROM v JOIN qv ON v.model = qv.model), vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM vs QUALIFY rank <= 50)"
_FU = "fu AS (SELECT qid, chunk_id, vr.rank AS vector_rank, br.rank AS bm25_rank, round(coalesce(1e0 / (60 + vr.rank), 0) + coalesce(1e0 / (60 + br.rank), 0), 6) AS rrf FROM vr FULL JOIN br USING (qid, chunk_id))"
_CU = "cu AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) <= 30), hi AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, chunk_id) AS place FROM cu JOIN k USING (chunk_id) QUALIFY place <= 15)"
_BASE = (LIVE, CHUNKS, _Q)
_ALL = (*_BASE, _V, _QV, _BM, _VR, _FU)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.chunk_rows(read_table(spark, sf_dir, "chunks"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = catalogue.live_concepts(read_table(spark, sf_dir, "concepts"))
    return live.filter("concept_type = 'Runbook'").select(F.col("concept_id").alias("qid"), F.col("title").alias("q"))


def _vectors(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """The usable vector of each chunk and model; of the chunks of ``of`` (chunk_id) only, if given."""
    v = F.col("vector")
    rows = read_table(spark, sf_dir, "chunks").join(F.broadcast(read_table(spark, sf_dir, "embedders")), "model")
    rows = rows.filter((F.size(v) == F.col("dim")) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0))
    rows = rows if of is None else rows.join(of, "chunk_id", "left_semi")
    return rows.groupBy("chunk_id", "model").agg(F.min("vector").alias("vector"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions with their vectors, materialised, as they are read several times."""
    q, chunks = cut(_questions(spark, sf_dir)), _chunks(spark, sf_dir).select("chunk_id", F.col("concept_id").alias("qid"), "chunk_index")
    own = cut(chunks.join(retrieval.small_side(q.select("qid")), "qid", "left_semi"))
    first = own.join(_vectors(spark, sf_dir, retrieval.small_side(own.select("chunk_id"))), "chunk_id").groupBy("qid").agg(F.min_by(F.struct(F.col("vector").alias("qvec"), "model"), F.struct("chunk_index", "model")).alias("v"))
    return cut(q.join(first, "qid", "left").select("qid", "q", "v.qvec", "v.model"))


def _long(*columns: str):
    return [F.col(c).cast("bigint").alias(c) for c in columns]


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_ranks(index.build_index(_chunks(spark, sf_dir)), _questions(spark, sf_dir))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(_vectors(spark, sf_dir), _asked(spark, sf_dir).filter("qvec IS NOT NULL"), model="model")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(_near(spark, sf_dir), _words(spark, sf_dir))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return retrieval.search(chunks, index.build_index(chunks), _asked(spark, sf_dir), _vectors(spark, sf_dir), model="model")


@query(with_(*_BASE, _BM) + "SELECT qid, chunk_id, score, rank FROM br")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("qid", "chunk_id", "score", *_long("rank"))


@query(with_(*_BASE, _BM) + ", x AS (SELECT bs.* FROM bs JOIN k USING (chunk_id) WHERE sensitivity = 'work') SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM x QUALIFY rank <= 50")
def bm25_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    allowed = retrieval.filters(chunks, sensitivity="work").select("chunk_id")
    return retrieval.keyword_ranks(index.build_index(chunks), _questions(spark, sf_dir), allowed=allowed).select("qid", "chunk_id", "score", *_long("rank"))


@query(with_(*_BASE, _V, _QV, _VR) + "SELECT qid, chunk_id, score, rank FROM vr")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("qid", "chunk_id", "score", *_long("rank"))


@query("WITH s AS (SELECT a.vec_id AS qid, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE b.label = 3) SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10")
def knn_topk_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    asked = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return retrieval.nearest(e.filter("label = 3"), asked, "vec_id", "embedding", 10).select("qid", "vec_id", "score", *_long("rank"))


@query(with_(*_ALL) + "SELECT qid, chunk_id, rrf FROM fu")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reciprocal_rank_fusion([_near(spark, sf_dir), _words(spark, sf_dir)])


@query(with_(*_ALL) + "SELECT qid, chunk_id, coalesce(vector_rank, 0) AS vector_rank, coalesce(bm25_rank, 0) AS bm25_rank, rrf FROM fu")
def set1_fused_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("qid", "chunk_id", F.coalesce("vector_rank", F.lit(0)).cast("bigint").alias("vector_rank"), F.coalesce("bm25_rank", F.lit(0)).cast("bigint").alias("bm25_rank"), "rrf")


@query(with_(*_ALL, _CU) + "SELECT qid, chunk_id, rrf AS score, place FROM hi")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("qid", "chunk_id", "score", *_long("place"))


@query(_graph_sql(*_ALL, _LINKS.replace("k AS (", "kl AS (").replace("FROM k UNION", "FROM kl UNION").replace("FROM k)", "FROM kl)")) + """, se AS (SELECT DISTINCT qid, concept_id FROM (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) <= 20) JOIN k USING (chunk_id)),
ne AS (SELECT DISTINCT qid, b AS concept_id FROM se JOIN u ON a = concept_id EXCEPT SELECT * FROM se), fc AS (SELECT chunk_id, concept_id FROM k QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY chunk_index, chunk_id) <= 2)
SELECT DISTINCT qid, chunk_id FROM ne JOIN fc USING (concept_id) WHERE NOT EXISTS (SELECT 1 FROM fu WHERE fu.qid = ne.qid AND fu.chunk_id = fc.chunk_id)""")
def rt4_graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.link_edges(read_table(spark, sf_dir, "links_to"), read_table(spark, sf_dir, "concepts"))
    return retrieval.expand(_fused(spark, sf_dir), _chunks(spark, sf_dir), edges).filter("from_graph").select("qid", "chunk_id")


@query(with_(LIVE, CHUNKS) + "SELECT concept_id, chunk_id FROM k WHERE concept_id IN (SELECT concept_id FROM l) QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY chunk_index, chunk_id) <= 2")
def w4_first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = catalogue.live_concepts(read_table(spark, sf_dir, "concepts")).select(F.lit(1).alias("qid"), "concept_id")
    return retrieval.first_chunks(_chunks(spark, sf_dir), live).select("concept_id", "chunk_id")


@query(with_(*_ALL, _CU) + "SELECT qid, concept_id, max(rrf) AS score, count(*) AS passages, min(place) AS place FROM hi GROUP BY ALL")
def rt7_group_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.group_hits(_hits(spark, sf_dir)).select("qid", "concept_id", "score", "passages", *_long("place"))


@query(with_(*_ALL, _CU) + "SELECT qid, max(rrf) < 0.2 AS weak FROM hi GROUP BY 1")
def prj12_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.is_weak(retrieval.group_hits(_hits(spark, sf_dir)))


@query(with_(*_ALL, _CU) + "SELECT qid, chunk_id, array_to_string(list_filter([CASE WHEN vector_rank IS NOT NULL THEN 'vector#' || vector_rank END, CASE WHEN bm25_rank IS NOT NULL THEN 'bm25#' || bm25_rank END], lambda x: x IS NOT NULL), ' ') AS found_by FROM hi")
def prj13_found_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = retrieval.found_by(F.col("vector_rank"), F.col("bm25_rank"), F.col("from_graph"))
    return _hits(spark, sf_dir).select("qid", "chunk_id", F.array_join(labels, " ").alias("found_by"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]+'), lambda w: w <> ''))"
_RR = f"rr AS (SELECT qid, chunk_id, rrf, CAST(len(list_intersect({_WORDS.format('q')}, {_WORDS.format('left(text, 700)')})) AS DOUBLE) / len({_WORDS.format('q')}) AS rerank FROM cu JOIN k USING (chunk_id) JOIN q USING (qid)), re AS (SELECT qid, chunk_id, rerank, round(CASE WHEN rerank <> 0 THEN rerank ELSE rrf END, 6) AS score FROM rr)"


@query(with_(*_ALL, _CU, _RR) + "SELECT qid, chunk_id, round(rerank, 6) AS rerank, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS place FROM re QUALIFY place <= 15")
def rt5_reranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    hits = retrieval.search(chunks, index.build_index(chunks), _asked(spark, sf_dir), _vectors(spark, sf_dir), reranker=retrieval.lexical_overlap, model="model")
    return hits.select("qid", "chunk_id", F.round("rerank", 6).alias("rerank"), "score", *_long("place"))


_RK = "rk AS (SELECT qid, concept_id, row_number() OVER (PARTITION BY qid ORDER BY place, concept_id) AS rank FROM (SELECT qid, concept_id, min(place) AS place FROM hi GROUP BY ALL))"


@query(with_(*_ALL, _CU, _RK) + "SELECT qid, concept_id, rank FROM rk")
def w8_concept_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.concept_ranks(_hits(spark, sf_dir)).select("qid", "concept_id", *_long("rank"))


_ASKED = _Q.replace(" FROM l WHERE", " FROM l WHERE", 1).removesuffix(")") + " UNION ALL SELECT 'none/' || n_nationkey, lower(n_name) || ' zzyzx' FROM nation)"
_RANKED = "hr AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS place FROM re QUALIFY place <= 15), rk AS (SELECT qid, concept_id, row_number() OVER (PARTITION BY qid ORDER BY place, concept_id) AS rank FROM (SELECT qid, concept_id, min(place) AS place FROM hr JOIN k USING (chunk_id) GROUP BY ALL))"


@query(
    with_(LIVE, CHUNKS, _ASKED, _V, _QV, _BM, _VR, _FU, _CU, _RR, _RANKED)
    + ", x AS (SELECT qid, starts_with(qid, 'none/') AS open, (SELECT min(rank) FROM rk WHERE rk.qid = q.qid AND rk.concept_id = q.qid) AS rank, (SELECT max(score) FROM hr WHERE hr.qid = q.qid) AS best FROM q) SELECT "
    + ", ".join(f"round(avg(CASE WHEN open THEN NULL WHEN rank <= {k} THEN 1e0 ELSE 0e0 END), 6) AS hit_{k}" for k in (1, 3, 5, 10))
    + ", round(avg(CASE WHEN NOT open THEN coalesce(1e0 / rank, 0) END), 6) AS mrr, round(avg(CASE WHEN open THEN CASE WHEN coalesce(best, 0) < 0.2 THEN 1e0 ELSE 0e0 END END), 6) AS abstention, round(avg(CASE WHEN NOT open THEN CASE WHEN coalesce(best, 0) >= 0.2 THEN 1e0 ELSE 0e0 END END), 6) AS confidence FROM x"
)
def ev1_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runbooks' titles as questions, and questions that no concept answers: a nation's name and a word of no language."""
    asked = _asked(spark, sf_dir)
    open_ = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("none/"), F.col("n_nationkey").cast("string")).alias("qid"), F.concat(F.lower("n_name"), F.lit(" zzyzx")).alias("q"), F.lit(None).cast(asked.schema["qvec"].dataType).alias("qvec"), F.lit(None).cast("string").alias("model"))
    asked = cut(asked.unionByName(open_))
    chunks = _chunks(spark, sf_dir)
    hits = cut(retrieval.search(chunks, index.build_index(chunks), asked, _vectors(spark, sf_dir), reranker=retrieval.lexical_overlap, model="model").select("qid", "concept_id", "place", "score"))
    none = F.array().cast("array<string>")
    questions = asked.select("qid", F.when(F.startswith("qid", F.lit("none/")), none).otherwise(F.array("qid")).alias("concepts"))
    best = hits.groupBy("qid").agg(F.max("score").alias("best_score"))
    return evaluation.metrics(evaluation.question_results(questions, evaluation.concept_ranks(hits), best))


@query()
def ev2_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = _chunks(spark, sf_dir), _asked(spark, sf_dir)
    edges = graph.link_edges(read_table(spark, sf_dir, "links_to"), read_table(spark, sf_dir, "concepts"))
    words, near = (cut(x) for x in retrieval.rankings(chunks, index.build_index(chunks), asked, _vectors(spark, sf_dir), model="model"))
    chunks = cut(chunks.select("chunk_id", "concept_id", "chunk_index", "text"))
    out = None
    for label, options in {"full": {"near": near, "edges": edges, "reranker": retrieval.lexical_overlap}, "no reranker": {"near": near, "edges": edges}, "no graph": {"near": near, "reranker": retrieval.lexical_overlap}, "keywords": {"near": None}}.items():
        hits = cut(retrieval.answers(chunks, asked, words=words, **options).select("qid", "concept_id", "place", "score"))
        best = hits.groupBy("qid").agg(F.max("score").alias("best_score"))
        one = evaluation.metrics(evaluation.question_results(asked.select("qid", F.array("qid").alias("concepts")), evaluation.concept_ranks(hits), best)).withColumn("variant", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out


@query(with_(CHUNKS) + r""", s AS (SELECT chunk_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z("''\[])', '\1' || chr(57344) || '\2', 'g'), chr(57344)) AS parts FROM k), e AS (SELECT chunk_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS n FROM s),
w AS (SELECT *, len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '')) AS words FROM e), h AS (SELECT chunk_id, sentence FROM w WHERE words BETWEEN 8 AND 40 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY words DESC, n) = 1),
p AS (SELECT chunk_id, sentence AS query, trim(replace(text, sentence, '')) AS text FROM h JOIN k USING (chunk_id)) SELECT * FROM p WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 25 ORDER BY md5(chunk_id || '11'), chunk_id LIMIT 150""")
def ev3_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.build_probes(_chunks(spark, sf_dir), 150)


@query(
    "WITH t AS (SELECT a.vec_id AS qid, min(b.vec_id) AS target FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id > a.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1), s AS (SELECT a.vec_id AS qid, b.vec_id AS key, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN t ON t.qid = a.vec_id, embeddings b WHERE a.vec_id <> b.vec_id), "
    "o AS (SELECT s.qid, score AS own FROM s JOIN t ON s.qid = t.qid AND s.key = t.target), r AS (SELECT qid, CAST(sum((score > own)::INT) AS BIGINT) + 1 AS rank FROM s JOIN o USING (qid) GROUP BY 1) SELECT round(avg(CASE WHEN rank <= 1 THEN 1e0 ELSE 0e0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0e0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1e0 ELSE 0e0 END), 6) AS recall_10, round(avg(1e0 / rank), 6) AS mrr FROM r"
)
def ev4_probe_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of an id divisible by 100 are probes; the target of each is the next vector of its label, among all vectors."""
    e = read_table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label")
    follow = F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))
    target = e.select(F.col("vec_id").alias("qid"), follow.alias("target")).filter("target IS NOT NULL")
    return evaluation.recall(evaluation.target_ranks(e, asked.join(target, "qid"), "vec_id", "embedding"))


@query("WITH r AS (SELECT DISTINCT run_id, epoch_ms(CAST(finished_at AS TIMESTAMPTZ)) - epoch_ms(CAST(started_at AS TIMESTAMPTZ)) AS ms FROM runs WHERE finished_at IS NOT NULL), v AS (SELECT list_sort(list(CAST(ms AS DOUBLE))) AS v FROM r) SELECT median(CAST(ms AS DOUBLE)) AS median, avg(CAST(ms AS DOUBLE)) AS mean, min(CAST(ms AS DOUBLE)) AS least, max(CAST(ms AS DOUBLE)) AS most, (SELECT v[greatest(1, CAST(floor(len(v) * 0.9) AS BIGINT))] FROM v) AS p90 FROM r")
def agg18_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read_table(spark, sf_dir, "runs").select("run_id", "started_at", "finished_at").filter("finished_at IS NOT NULL").distinct()
    ms = F.unix_millis(F.try_to_timestamp("finished_at")) - F.unix_millis(F.try_to_timestamp("started_at"))
    return evaluation.latencies(runs.select(ms.cast("double").alias("ms")))


@query(with_(CHUNKS) + r", t AS (SELECT chunk_id, regexp_extract_all(lower(title || ' ' || coalesce(heading_path, '') || ' ' || text), '[\p{L}\p{N}]+') AS terms FROM k), p AS (SELECT chunk_id, unnest(terms) AS term FROM t) SELECT term, count(DISTINCT chunk_id) AS chunks, count(*) AS occurrences FROM p GROUP BY 1")
def snk8_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = index.build_index(_chunks(spark, sf_dir))
    return built.postings.groupBy("term").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tf").alias("occurrences"))


@query()
def f21_stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword ranking over stems; compared with a brute-force one on a fixture."""
    built = index.stemmed(index.build_index(_chunks(spark, sf_dir)))
    return retrieval.keyword_ranks(built, _questions(spark, sf_dir), stemmed=True).select("qid", "chunk_id", "score", *_long("rank"))


@query(with_(LIVE, CHUNKS) + r", t AS (SELECT chunk_id, concept_id, unnest(regexp_extract_all(lower(title || ' ' || coalesce(heading_path, '') || ' ' || text), '[\p{L}\p{N}]+')) AS term FROM k WHERE concept_type <> 'Invoice') SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY ALL")
def man6_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index made when runbooks read otherwise and invoices were there, brought up to date: runbooks are read again, invoices are gone, the rest stays."""
    now = _chunks(spark, sf_dir)
    before = now.withColumn("text", F.when(F.col("concept_type") == "Runbook", F.concat(F.lit("obsolete "), F.reverse("text"))).otherwise(F.col("text")))
    now = now.filter("concept_type <> 'Invoice'")
    shape = ["concept_id", "chunk_id", "title", "heading_path", "text"]
    documents = lambda rows: rows.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct(*shape[1:]))).alias("parts"))
    fresh, stale = index.changed_concepts(index.fingerprints(documents(now)), index.fingerprints(documents(before)))
    owner = lambda rows: rows.select("chunk_id", "concept_id")
    old = index.build_index(before).postings.join(owner(before), "chunk_id")
    changed = now.join(fresh, "concept_id", "left_semi")
    new = index.build_index(changed).postings.join(owner(changed), "chunk_id")
    return index.replace_rows(old, stale, new.select(*old.columns)).select("chunk_id", "term", "tf")
