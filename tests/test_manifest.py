from pyspark.sql import functions as F

from archivolt.operators import bundle, catalogue, manifest

FILES = "path string, root string, ext string, size bigint, inode bigint, mtime double, mime string, hash string, extract_path string, extract_engine string, error string, run_id string, scan_status string, extract_status string, word_count bigint, first_seen string, last_seen string"


def row(path, size=1, inode=1, mtime=1.0, hash="h", run="r1", scan="included", extract="ok", first="2024-01-01T00:00:00Z", last="2024-01-01T00:00:00Z"):
    return (path, "/r", ".md", size, inode, mtime, "text/markdown", hash, "p", "plain", None, run, scan, extract, 5, first, last)


def test_upsert_and_missing(spark):
    old = spark.createDataFrame([row("/r/same"), row("/r/changed"), row("/r/denied"), row("/r/gone"), row("/rx/other")], FILES)
    seen = spark.createDataFrame([row("/r/same"), row("/r/changed", size=2), row("/r/denied", scan="denied"), row("/r/new", hash=None)], FILES)
    got = {r["path"]: r for r in manifest.mark_missing(manifest.upsert_stat(old, seen, "r2", "now"), "r2", ["/r"]).collect()}
    assert (got["/r/same"]["hash"], got["/r/same"]["extract_status"], got["/r/same"]["first_seen"]) == ("h", "ok", "2024-01-01T00:00:00Z")
    assert (got["/r/changed"]["hash"], got["/r/changed"]["extract_status"], got["/r/changed"]["word_count"]) == (None, "pending", 5)
    assert (got["/r/denied"]["hash"], got["/r/denied"]["size"]) == (None, 0)
    assert (got["/r/new"]["first_seen"], got["/r/new"]["extract_status"]) == ("now", "pending")
    assert got["/r/gone"]["scan_status"] == "missing" and got["/rx/other"]["scan_status"] == "included"


def test_states_and_representatives(spark):
    rows = [row("/a", hash="H1 ", last="2024-01-02T00:00:00+02:00"), row("/a", hash="h0", last="2024-01-01T12:00:00Z"), row("/b", hash="H1"), row("/c", hash=None), row("/a", hash="H1 ", last="2024-01-02T00:00:00+02:00")]
    states = catalogue.file_states(spark.createDataFrame(rows, FILES))
    assert {r["path"]: r["hash"] for r in states.collect()} == {"/a": "h1", "/b": "h1", "/c": None}
    assert [tuple(r) for r in manifest.representatives(states).select("hash", "path", "copies").collect()] == [("h1", "/a", 2)]
    assert catalogue.file_states(spark.createDataFrame([], FILES)).count() == 0


def test_ids_are_frozen_and_collide_by_hash(spark):
    new = spark.createDataFrame([("aaaaaa1", "Report", "Same"), ("bbbbbb1", "Report", "Same"), ("cccccc1", "Report", "Index"), ("dddddd1", "Report", "Taken")], "source_hash string, concept_type string, title string")
    taken = spark.createDataFrame([("report/taken",)], "concept_id string")
    got = dict(map(tuple, bundle.allocate_ids(new, taken).collect()))
    assert got == {"aaaaaa1": "report/same", "bbbbbb1": "report/same-bbbbbb", "cccccc1": "report/index-concept", "dddddd1": "report/taken-dddddd"}
    old = spark.createDataFrame([("aaaaaa1", "report/old", "t")], "source_hash string, concept_id string, title string")
    saved = manifest.save_concepts(old, spark.createDataFrame([("aaaaaa1", "report/new", "u")], "source_hash string, concept_id string, title string"))
    assert tuple(saved.select("concept_id", "title").first()) == ("report/old", "u")


def test_related_links_are_symmetric(spark):
    rows = [("a", ["x", "y"], [("P", "person")]), ("b", ["x"], [("p", "person")]), ("c", ["z"], []), ("d", None, None)]
    records = spark.createDataFrame(rows, "concept_id string, tags array<string>, entities array<struct<name:string,kind:string>>")
    got = {(r["concept_id"], r["peer"]): r["score"] for r in bundle.related(records).collect()}
    assert set(got) == {("a", "b"), ("b", "a")} and got["a", "b"] == got["b", "a"] > 1.5


def test_validator(spark):
    docs = [("a/x.md", "---\ntype: Report\ntitle: X\ndescription: d\n---\n[y](/a/y.md) [z](/a/gone.md)"), ("a/y.md", "---\ntype: \"\"\n---\nbody"), ("a/z.md", "no frontmatter"), ("a/w.md", "---\ntype: T\n---\n"), ("index.md", "---\nokf_version: \"1\"\n---\n"), ("a/index.md", "---\nq: 1\n---\n"), ("log.md", "## 2024-01-01\n## 2024-02-01\n## bad\n")]
    got = {(r["level"], r["path"], r["message"]) for r in bundle.validate(spark.createDataFrame(docs, "path string, text string")).collect()}
    assert ("error", "a/z.md", "the frontmatter cannot be read") in got and ("error", "a/y.md", "the frontmatter names no `type`") in got
    assert ("error", "a/index.md", "only the root index may have frontmatter") in got and ("warning", "log.md", "the log's days are out of order") in got
    assert ("warning", "a/x.md", "nothing is at the link's target: /a/gone.md") in got and ("error", "log.md", "no date in the log heading `## bad`") in got
    assert not any(p == "index.md" for _, p, _ in got)


def test_extract_results_apply_to_all_paths(spark):
    files = spark.createDataFrame([row("/a", extract="pending"), row("/b", extract="pending"), row("/c", hash="k")], FILES)
    results = spark.createDataFrame([("h", "empty", None, "plain", 0, None)], "hash string, status string, extract_path string, engine string, word_count bigint, error string")
    got = {r["path"]: r["extract_status"] for r in manifest.set_extract_result(files, results).select("path", F.col("extract_status")).collect()}
    assert got == {"/a": "empty", "/b": "empty", "/c": "ok"}
