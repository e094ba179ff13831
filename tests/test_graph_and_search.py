import pytest
from pyspark.sql import functions as F

from archivolt.operators import bundle, cypher, evaluation, graph, index, retrieval

CONCEPTS = "source_hash string, concept_id string, concept_type string, title string, description string, tags string, entities string, sensitivity string, status string, enrich_status string, error string, model string, generated_at string, ingest_run string, written_at string"


def concept(h, cid, kind, tags, entities, at):
    ents = "[" + ", ".join(f'{{"name": "{n}", "kind": "{k}"}}' for n, k in entities) + "]"
    return (h, cid, kind, cid, "d", "[" + ", ".join(f'"{t}"' for t in tags) + "]", ents, "work", "stable", "ok", None, "m", at, "r", at)


@pytest.fixture(scope="module")
def tables(spark):
    works, ada = ("Nordlicht Works", "organization"), ("Ada Quill", "person")
    rows = [concept("1f1f", "guide/reseal", "Guide", ["ops", "valve"], [works, ada], "2026-08-01T00:00:00Z"), concept("2e2e", "guide/settle", "Guide", ["ops"], [("NORDLICHT WORKS", "organization")], "2026-08-02T00:00:00Z"), concept("3d3d", "survey/harvest", "Report", ["crops"], [ada, ("Nordlicht Works", "project"), ("tool.py", "system")], "2026-07-15T00:00:00Z")]
    concepts = spark.createDataFrame(rows + rows[:1], CONCEPTS)
    links = spark.createDataFrame([("guide/reseal", "/guide/settle.md"), ("guide/reseal", "./settle.md"), ("guide/reseal", "/guide/nowhere.md")], "from_id string, target string")
    files = spark.createDataFrame([("/a/reseal.md", "1f1f", ".md", 100, 1.0), ("/a/settle.md", "2e2e", ".md", 200, 2.0), ("/a/harvest.pdf", "3d3d", ".pdf", 300, 3.0)], "path string, hash string, ext string, size bigint, mtime double")
    return concepts, links, files


def test_counts(tables):
    concepts, links, files = tables
    counts = [graph.concept_nodes(concepts), graph.file_nodes(files, concepts), graph.entity_nodes(concepts), graph.tag_nodes(concepts), graph.link_edges(links, concepts), graph.derived_edges(files, concepts), graph.mention_edges(concepts), graph.tag_edges(concepts), graph.broken_links(links, concepts)]
    assert [c.count() for c in counts] == [3, 3, 3, 3, 1, 3, 5, 4, 1]
    ada = graph.entity_nodes(concepts).filter("key = 'person:ada quill'").select("occurrence_count", F.date_format("first_seen", "yyyy-MM-dd")).first()
    assert tuple(ada) == (2, "2026-07-15")


def test_hops_and_parents(spark, tables):
    concepts, links, _ = tables
    seeds = spark.createDataFrame([(1, "guide/settle")], "qid int, concept_id string")
    assert [r["concept_id"] for r in graph.neighbours(graph.link_edges(links, concepts), seeds).collect()] == ["guide/reseal"]
    ids = spark.createDataFrame([("a",), ("a/b",), ("a/b/c/d",), ("x/y",)], "concept_id string")
    assert sorted(map(tuple, graph.child_edges(ids).collect())) == [("a/b", "a"), ("a/b/c/d", "a/b")]


def test_duplicates(spark):
    names = ["Dana", "Dana Reyes", "dreyes@x.org", "Sam Poole", "SAM POOLE", "sam@x.org", "other@x.org"]
    nodes = spark.createDataFrame([(f"person:{n.lower()}", n, "person") for n in names] + [("project:dana", "Dana", "project")], "key string, name string, kind string")
    got = {(r["key_a"], r["key_b"], r["reason"]) for r in graph.duplicate_candidates(nodes).collect()}
    assert got == {("person:dana", "person:dana reyes", "contained"), ("person:dana reyes", "person:dreyes@x.org", "email"), ("person:sam poole", "person:sam@x.org", "email")}


@pytest.fixture(scope="module")
def compiled(tables):
    concepts, links, _ = tables
    two = lambda rows, a, b: rows.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"))
    nodes = {"Concept": (graph.concept_nodes(concepts), "concept_id"), "Entity": (graph.entity_nodes(concepts), "key"), "Tag": (graph.tag_nodes(concepts), "tag")}
    return cypher.Graph(nodes, {"LINKS_TO": (graph.link_edges(links, concepts), "Concept", "Concept"), "MENTIONS": (two(graph.mention_edges(concepts), "concept_id", "key"), "Concept", "Entity"), "TAGGED_AS": (two(graph.tag_edges(concepts), "concept_id", "tag"), "Concept", "Tag")})


@pytest.mark.parametrize(
    "text, rows",
    [
        ("MATCH (n) RETURN count(n)", [(9,)]),
        ("MATCH (c:Concept)-[:MENTIONS]->(e:Entity {kind: 'person'}) RETURN e.name AS who, count(DISTINCT c) AS n ORDER BY n DESC LIMIT 5", [("Ada Quill", 2)]),
        ("MATCH (a)-[:MENTIONS]->(e)<-[:MENTIONS]-(b) WHERE e.kind = 'organization' AND a.concept_id < b.concept_id RETURN a.concept_id AS x, b.concept_id AS y", [("guide/reseal", "guide/settle")]),
        ("MATCH (a:Concept)-[:LINKS_TO]-(b) WHERE a.concept_id IN ['guide/settle'] RETURN DISTINCT b.concept_id AS id", [("guide/reseal",)]),
        ("MATCH (c:Concept)-[r:TAGGED_AS]->(t:Tag) RETURN count(r) AS n", [(4,)]),
        ("MATCH (a:Concept {concept_id: 'it''s'}) RETURN a", []),
        ("MATCH (c:Concept) WHERE c.type = 'Memo' OR c.type = 'Guide' AND NOT c.concept_id CONTAINS 'settle' RETURN c.concept_id AS id ORDER BY id", [("guide/reseal",)]),
        ("MATCH (c:Concept) WHERE (c.concept_id STARTS WITH 'guide' OR c.concept_id ENDS WITH 'vest') AND c.title IS NOT NULL RETURN c.concept_id AS id ORDER BY id DESC SKIP 1 LIMIT 1", [("guide/settle",)]),
        ("MATCH (c:Concept)-[:TAGGED_AS]->(t:Tag) RETURN c.concept_id AS id, collect(t.tag) AS tags, min(t.tag) AS low, sum(t.concept_count) AS s, avg(t.concept_count) AS m ORDER BY id LIMIT 1", [("guide/reseal", ["ops", "valve"], "ops", 3, 1.5)]),
        ("MATCH (c:Concept)-[:MENTIONS]->(e:Entity) WITH e.kind AS kind, count(DISTINCT e) AS n WHERE n > 0 AND NOT kind = 'project' RETURN kind, n ORDER BY kind", [("organization", 1), ("person", 1)]),
        ("MATCH (c:Concept) OPTIONAL MATCH (c)-[:LINKS_TO]->(d:Concept) RETURN c.concept_id AS id, d.concept_id AS to ORDER BY id", [("guide/reseal", "guide/settle"), ("guide/settle", None), ("survey/harvest", None)]),
        ("MATCH (c:Concept) OPTIONAL MATCH (c)-[:MENTIONS]->(e:Entity) WHERE e.kind = 'project' RETURN c.concept_id AS id, count(e) AS n ORDER BY id", [("guide/reseal", 0), ("guide/settle", 0), ("survey/harvest", 1)]),
    ],
)
def test_cypher(compiled, text, rows):
    assert [tuple(r) for r in cypher.run(compiled, text).collect()] == rows


@pytest.mark.parametrize("text", ["CREATE (n)", "MATCH (a:Nope) RETURN a", "MATCH (a:Concept) RETURN a.nope", "MATCH (a:Concept)-[:NOPE]->(b) RETURN a", "MATCH (a:Concept RETURN a", "MATCH (a:Concept) RETURN a; DROP", ""])
def test_cypher_refuses(compiled, text):
    with pytest.raises(cypher.QueryError):
        cypher.run(compiled, text).collect()


CHUNKS = [("guide/reseal#0", "guide/reseal", "work", "Restart", "", 0, "Stop the widget service, wait thirty seconds, start it."), ("runbook/invoice#0", "runbook/invoice", "personal", "Invoice", None, 0, "Quarterly revenue reached four million dollars in total.")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, concept_id string, sensitivity string, title string, heading_path string, chunk_index int, text string").withColumn("source", F.lit("local")).withColumn("concept_type", F.lit("Guide"))


def letters(text):
    v = [0.0] * 16
    for c in text:
        v[ord(c) % 16] += 1
    return v


def test_search(spark, chunks):
    vectors = spark.createDataFrame([(c[0], letters(c[6])) for c in CHUNKS] + [("n", None), ("z", [0.0] * 16), ("w", [1.0])], "chunk_id string, vector array<float>")
    queries = spark.createDataFrame([(1, "widget service", letters("widget service")), (2, '")(*', letters("x")), (3, "", None)], "qid int, q string, qvec array<double>")
    built = index.build_index(chunks)
    top = {r["qid"]: r["concept_id"] for r in retrieval.search(chunks, built, queries, vectors).filter("place = 1").collect()}
    assert top[1] == "guide/reseal" and 3 not in top
    only = retrieval.search(chunks, built, queries, vectors, sensitivity="personal").collect()
    assert {r["concept_id"] for r in only} == {"runbook/invoice"}
    words = retrieval.search(chunks, built, queries, reranker=retrieval.lexical_overlap).collect()
    assert [(r["qid"], r["chunk_id"]) for r in words] == [(1, "guide/reseal#0")] and words[0]["score"] == 0.5
    assert retrieval.search(chunks.limit(0), index.build_index(chunks.limit(0)), queries).count() == 0


def test_fusion_constants(spark):
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "qid int, chunk_id string, rank int")
    got = {r["chunk_id"]: r["rrf"] for r in retrieval.reciprocal_rank_fusion([ranks, ranks.filter("rank = 1")]).collect()}
    assert got == {"a": round(2 / 61, 6), "b": round(1 / 62, 6)}


def test_metrics(spark):
    results = spark.createDataFrame([(1, True, 1, 0.5), (2, True, 4, 0.1), (3, True, None, None), (4, False, None, 0.1)], "qid int, answerable boolean, rank int, best_score double")
    m = evaluation.metrics(results).first()
    assert (m["hit_1"], m["hit_5"], m["mrr"], m["abstention"]) == (round(1 / 3, 6), round(2 / 3, 6), round(1.25 / 3, 6), 1.0)


def test_sharing_pairs_meet_once_however_many_share_a_term(spark):
    import random

    rng = random.Random(3)
    sets = {f"c{i:02}": {"common"} | set(rng.sample("abcdefgh", rng.randint(0, 5))) for i in range(40)} | {"none": {"own"}}
    edges = spark.createDataFrame([(c, t) for c, ts in sets.items() for t in ts], "concept_id string, tag string")
    want = sorted((a, b, sorted(sets[a] & sets[b])[:3]) for a in sets for b in sets if a < b and sets[a] & sets[b])
    for held in (1_000, 7):
        assert sorted(map(tuple, bundle.sharing_pairs(edges, "tag", held=held).collect())) == want
    assert bundle.sharing_pairs(edges.limit(0), "tag").count() == 0


def _shuffled(node):
    """Rows that the exchanges of an executed plan wrote."""
    name, metrics = node.getClass().getSimpleName(), node.metrics()
    if name == "AdaptiveSparkPlanExec":
        return _shuffled(node.finalPhysicalPlan())
    below = [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
    own = metrics.apply("shuffleRecordsWritten").value() if metrics.contains("shuffleRecordsWritten") else 0
    return own + sum(map(_shuffled, below))


def test_sharing_pairs_shuffle_a_concept_once_for_a_term_of_thousands(spark):
    n = 2_500
    edges = spark.range(n).selectExpr("concat('c', id) AS concept_id", "'common' AS tag")
    rows = bundle.sharing_pairs(edges, "tag").groupBy().count()
    assert rows.collect()[0][0] == n * (n - 1) // 2
    assert _shuffled(rows._jdf.queryExecution().executedPlan()) < 3 * n


def test_sharing_pairs_of_parts_meet_in_either_order(spark):
    sets = {f"c{k % 7}-{k}": {"x", "y"} if k % 3 else {"w", "y", "z", "zz", "x"} for k in range(60)}
    edges = spark.createDataFrame([(c, t) for c, ts in sets.items() for t in ts] * 2, "concept_id string, tag string")
    want = sorted((a, b, sorted(sets[a] & sets[b])[:3]) for a in sets for b in sets if a < b)
    for held in (1, 9):
        assert sorted(map(tuple, bundle.sharing_pairs(edges, "tag", held=held).collect())) == want
