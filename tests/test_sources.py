import json

import pytest
from pyspark.sql import functions as F

from archivolt.config import Config, Scan, load, load_aliases, load_questions
from archivolt.engine import Engine
from archivolt.operators import enrich
from archivolt.sources import cards, extract, meetings


@pytest.fixture()
def tree(tmp_path):
    for i in range(1, 4):
        (tmp_path / "notes").mkdir(exist_ok=True)
        (tmp_path / f"notes/note{i}.md").write_text(f"# Widget note {i}\n\nAcme Corp restarts the widget service number {i} for Bob Smith every Monday.\n")
    (tmp_path / "notes/copy.md").write_text((tmp_path / "notes/note1.md").read_text())
    (tmp_path / "latin.txt").write_bytes("Gr\xfc\xdfe aus M\xfcnchen, die Rechnung liegt bei.".encode("latin-1"))
    (tmp_path / "page.html").write_text("<html><body><p>The quarterly invoice was paid by Bob Smith.</p></body></html>")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "node_modules/pkg").mkdir(parents=True)
    (tmp_path / "node_modules/pkg/index.md").write_text("never listed")
    (tmp_path / "archive.zip").write_bytes(b"PK\x03\x04")
    (tmp_path / "code.py").write_text("print(1)")
    (tmp_path / "big.md").write_text("x" * 70_000)
    return tmp_path


def test_pipeline_end_to_end(spark, tree, tmp_path_factory):
    engine = Engine(spark, Config(warehouse=str(tmp_path_factory.mktemp("w")), scan=Scan(roots=(str(tree),), max_file_bytes=65_536)))
    assert dict(map(tuple, engine.scan("r1").collect())) == {"included": 7, "denied": 1, "no_route": 1, "too_large": 1}
    assert dict(map(tuple, engine.extract().collect())) == {"ok": 5, "empty": 1}
    assert dict(map(tuple, engine.enrich().collect())) == {"ok": 5}
    assert engine.bundle().filter("level = 'error'").count() == 0
    assert engine.index().first()[0] >= 5
    found = engine.search_knowledge("quarterly invoice")
    assert "page" in found["results"][0]["concept_id"] or "invoice" in found["results"][0]["preview"]
    assert engine.search_knowledge("  ")["error"]
    assert "error" in engine.get_concept("../../etc/passwd")
    assert engine.cypher("MATCH (c:Concept) RETURN count(c) AS n").first()[0] == 5
    assert "error" in engine.traverse("x", edge_types=("NOPE",))
    assert [n.name for n in fields_of(engine)] == ["CHILD_OF", "DERIVED_FROM", "LINKS_TO", "MENTIONS", "TAGGED_AS"]
    assert engine.cypher("MATCH (c:Concept)-[:DERIVED_FROM]->(f:File) RETURN count(f) AS n").first()[0] == 5
    before = {r["chunk_id"]: r["text"] for r in engine.read("chunks").collect()}
    (tree / "notes/note2.md").unlink()
    (tree / "notes/note4.md").write_text("# Widget note 4\n\nThe harbour crane is greased by Bob Smith on Fridays.\n")
    stats = engine.drain("r2")
    assert engine.read("files").filter("scan_status = 'missing'").count() == 1
    assert engine.read("concepts").filter("status = 'deprecated'").count() == 1
    # only what changed was split again, and the index is that of a whole rebuild
    assert stats["changed"] == 1 and stats["enriched"] == 1 and stats["waiting"] == 0
    parts = {n: sorted(map(str, engine.read(n).collect())) for n in ("chunks", "postings", "lengths", "stats")}
    engine.index(whole=True)
    assert parts == {n: sorted(map(str, engine.read(n).select(*columns(parts[n])).collect())) for n in parts}
    after = {r["chunk_id"]: r["text"] for r in engine.read("chunks").collect()}
    assert any("crane" in t for t in after.values()) and sum(k in before and before[k] == t for k, t in after.items()) >= 4
    runs = {r["run_id"]: r for r in engine.read("runs").collect()}
    assert {"r1", "r2", "r2-scan"} <= set(runs) and all(r["finished_at"] for r in runs.values()) and '"enriched": 1' in runs["r2"]["stats"]


def fields_of(engine):
    from types import SimpleNamespace

    return [SimpleNamespace(name=n) for n in sorted(engine.graph_tables().edges)]


def columns(rows):
    import re

    return re.findall(r"(\w+)=", re.sub(r"='(?:[^'\\\\]|\\\\.)*'", "=", rows[0])) if rows else ["*"]


def test_only_what_has_no_hash_is_read(spark, tree, tmp_path_factory):
    engine = Engine(spark, Config(warehouse=str(tmp_path_factory.mktemp("w")), scan=Scan(roots=(str(tree),))))
    engine.scan("r1")
    hashes = {r["path"]: r["hash"] for r in engine.read("files").collect()}
    kept = tree / "latin.txt"
    stat = kept.stat()
    kept.write_bytes(bytes(stat.st_size))  # other bytes, but size, time and inode tell nothing
    import os

    os.utime(kept, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    (tree / "new.md").write_text("something new here")
    engine.scan("r2")
    again = {r["path"]: r["hash"] for r in engine.read("files").collect()}
    assert again[str(kept)] == hashes[str(kept)] and again[str(tree / "new.md")] and {k: again[k] for k in hashes} == hashes


def test_a_version_counts_once_it_is_complete(spark, tmp_path):
    engine = Engine(spark, Config(warehouse=str(tmp_path)))
    assert not engine.has("t")
    with pytest.raises(FileNotFoundError):
        engine.read("t")
    for n in (1, 2, 3):
        engine.write(spark.range(n), "t")
    assert engine.read("t").count() == 3
    (tmp_path / "t/v00000009").mkdir()  # a write that was cut short
    assert engine.read("t").count() == 3
    engine.write(engine.read("t").union(spark.range(1)), "t")
    assert engine.read("t").count() == 4 and len(engine._versions("t")) == 2


def test_an_unfinished_run_is_seen(spark, tmp_path):
    engine = Engine(spark, Config(warehouse=str(tmp_path)))
    with pytest.raises(RuntimeError), engine.run("extract", "x"):
        raise RuntimeError("executor lost")
    from archivolt.operators.manifest import unfinished_runs

    assert [r["run_id"] for r in unfinished_runs(engine.read("runs")).collect()] == ["x"]


def test_questions_and_aliases(tmp_path):
    (tmp_path / "q.toml").write_text('[[question]]\nid = "a"\ntext = " who? "\nexpect = ["x/y"]\n[[question]]\ntext = "unknown?"\n')
    assert load_questions(tmp_path / "q.toml") == [("a", "who?", ["x/y"]), ("2", "unknown?", [])]
    (tmp_path / "a.toml").write_text('[person]\n"Ada Quill" = ["A.  Quill", "ada"]\n')
    assert load_aliases(tmp_path / "a.toml") == [("person:a. quill", "person:ada quill"), ("person:ada", "person:ada quill")]
    (tmp_path / "b.toml").write_text('[person]\n"Ada" = ["x"]\n"Bea" = ["x"]\n')
    with pytest.raises(ValueError):
        load_aliases(tmp_path / "b.toml")


@pytest.mark.parametrize("raw, status", [(b"", "empty"), (b"  \n", "empty"), (b"a\r\nb", "ok"), (b"\0\0", "failed"), ("hé".encode("utf-16"), "ok"), (b"\xff\xfe\xfd caf\xe9", "ok")])
def test_plain_text(raw, status):
    assert extract.plain_text(raw).status == status


def test_errors_stay_with_their_file():
    assert extract.extract_bytes(b"x", ".pdf", "pdf").status == "failed"
    assert extract.extract_bytes(b"x", ".docx", "office").error == "no engine for .docx"
    assert extract.extract_bytes(None, ".md", "plain").status == "failed"
    assert extract.extract_bytes(b"x", ".q", "skip").status == "skipped"
    assert extract.group_lines([(0.5, 0.9, "b"), (0.1, 0.905, "a"), (0.1, 0.5, "c")]) == ["a b", "c"]


GOOD = {"id": "a-1", "project": "p", "occurred_at": "2026-01-02T03:04:05+02:00", "tool": "t", "source_ref": "s", "status": "paused", "summary": "x", "decisions": ["d"]}


@pytest.mark.parametrize("change, error", [({}, None), ({"id": "A b"}, "slug"), ({"occurred_at": "2026-01-02T03:04:05"}, "zone"), ({"status": "done"}, "status"), ({"extra": 1}, "fields that no card has: extra"), ({"summary": " "}, "summary is missing"), ({"decisions": ["d", "d "]}, "twice"), ({"decisions": [""]}, "blank")])
def test_cards(spark, change, error):
    rows = spark.createDataFrame([(json.dumps(GOOD | change),)], "value string")
    errors = rows.select(cards.card_errors(F.col("value"))).first()[0]
    assert (not errors) if error is None else error in errors[0]
    assert cards.valid_cards(rows).count() == (error is None)


def test_cards_are_never_overwritten(spark):
    card = cards.valid_cards(spark.createDataFrame([(json.dumps(GOOD),)], "value string"))
    path, content = card.select(cards.card_path(), cards.card_markdown()).first()
    assert path == "p/sessions/2026-01/a-1.md" and "- None." in content
    for present, outcome in ([], "captured"), ([(path, content)], "repeated"), ([(path, "else")], "conflict"):
        assert cards.capture_outcome(card, spark.createDataFrame(present, "path string, content string")).first()["outcome"] == outcome


def test_meetings(spark, tmp_path):
    items = [{"title": "Weekly Café", "created_at": "2026-02-03T10:00:00Z", "attendees": ["A", ""], "summary": "s", "transcript": [{"speaker": "A", "text": "hi"}, {"text": " "}]}, {"title": "nothing"}]
    for name, value in (("list.json", items), ("wrapped.json", {"results": items})):
        (tmp_path / name).write_text(json.dumps(value))
        rows = meetings.read_export(spark, str(tmp_path / name))
        got = {r["file"]: r for r in meetings.import_outcome(rows, spark.createDataFrame([], "file string, content string")).collect()}
        assert got["2026-02-03-weekly-café.md"]["outcome"] == "imported" and got["nothing.md"]["outcome"] == "skipped"
        text = got["2026-02-03-weekly-café.md"]["content"]
        assert text.startswith("# Weekly Café\n\n**Date:** 2026-02-03\n**Attendees:** A\n") and text.endswith("**A:** hi\n")
        again = meetings.import_outcome(rows, spark.createDataFrame([("2026-02-03-weekly-café.md", text)], "file string, content string"))
        assert {r["file"]: r["outcome"] for r in again.collect()}["2026-02-03-weekly-café.md"] == "unchanged"


def test_records_are_cleaned_and_failures_kept(spark):
    said = {"title": "  A  b ", "concept_type": "Nope", "tags": ["X", "x ", "-y-", ""], "entities": [{"name": "Acme", "kind": "Organization"}, {"name": "ACME", "kind": "organization"}, {"name": "a.md", "kind": "system"}, {"name": "q", "kind": "animal"}], "sensitivity": "secret"}

    def enricher(name, text):
        if text == "bad":
            raise RuntimeError("no model")
        return said

    rows = spark.createDataFrame([("h1", "n", "good"), ("h2", "n2", "bad")], "source_hash string, name string, text string")
    got = {r["source_hash"]: r for r in enrich.enrich(rows, enricher).collect()}
    good = got["h1"]
    assert (good["title"], good["concept_type"], good["tags"], good["sensitivity"]) == ("A b", "Other", ["x", "y"], "personal")
    assert [tuple(e) for e in good["entities"]] == [("Acme", "organization")]
    assert (got["h2"]["enrich_status"], got["h2"]["title"]) == ("failed", "n2")


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('warehouse = "w"\n[retrieval]\nrrf_k = 10\n')
    assert (load(tmp_path / "c.toml").retrieval.rrf_k, load().chunking.max_tokens) == (10, 800)
    (tmp_path / "d.toml").write_text("nope = 1\n")
    with pytest.raises(ValueError):
        load(tmp_path / "d.toml")


def test_files_are_written_whole_and_inside(spark, tmp_path):
    from archivolt.operators import enrich as en
    from archivolt.operators.reports import folder_megabytes
    from archivolt.sources import bundles

    whole = bundles.write_atomic(str(tmp_path), "a/b.md", "one")
    bundles.write_atomic(str(tmp_path), "a/b.md", "two")
    assert open(whole).read() == "two" and [p.name for p in (tmp_path / "a").iterdir()] == ["b.md"]
    (tmp_path / "out").symlink_to("/tmp")
    for path in ("../x.md", "/etc/passwd", "a/../../x", "out/x.md"):
        with pytest.raises(ValueError):
            bundles.write_atomic(str(tmp_path), path, "x")
    made = bundles.init_folder(str(tmp_path / "v"), "my-project")
    (tmp_path / "v/index.md").write_text("mine")
    assert len(made) == 3 and bundles.init_folder(str(tmp_path / "v"), "my-project") == [] and (tmp_path / "v/index.md").read_text() == "mine"
    with pytest.raises(ValueError):
        bundles.init_folder(str(tmp_path), "No Slug")
    (tmp_path / "big").mkdir()
    (tmp_path / "big/x").write_bytes(b"0" * 500_000)
    assert folder_megabytes(spark, str(tmp_path / "big")) == 0.5 and folder_megabytes(spark, str(tmp_path / "none")) == 0
    schema = en.response_schema()
    assert set(schema["required"]) == set(schema["properties"]) and schema["properties"]["entities"]["items"]["properties"]["kind"]["enum"] == list(en.KINDS)
