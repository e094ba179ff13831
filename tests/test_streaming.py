from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from archivolt.streaming import changes


def events(spark):
    base = pd.Timestamp("2024-01-01")
    rows = [(i, f"/p{k}", base + pd.Timedelta(seconds=s), "deleted" if k == 1 else "modified") for i, (k, s) in enumerate([(1, 0), (1, 2), (2, 1), (1, 10), (2, 100), (1, 13), (2, 103)])]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "path", "ts", "event"]))


def test_batch_forms_agree(spark):
    a = {tuple(r) for r in changes.settled_sessions(events(spark)).collect()}
    b = {tuple(r) for r in changes.session_bursts(events(spark)).collect()}
    assert a == b and len(a) == 4


def test_stream_equals_batch(spark, tmp_path):
    ordered = events(spark).union(spark.createDataFrame([(99, "/late", datetime(2024, 1, 2), "modified")], "event_id bigint, path string, ts timestamp, event string"))
    ordered.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ordered.schema).parquet(str(tmp_path / "in"))
    got = []
    query = changes.watch(stream, lambda rows, batch: got.extend(rows.select("path", "first", "last", "events").collect()), str(tmp_path / "cp"), seconds=None)
    query.awaitTermination(90)
    want = {(r["path"], r["first"], r["last"], r["events"]) for r in changes.settled_sessions(events(spark)).collect()}
    assert {tuple(r) for r in got} >= {w for w in want if w[0] == "/p1"} and {tuple(r) for r in got} <= want | {t for t in map(tuple, got) if t[0] == "/late"}


def test_last_events_moves_and_outcomes(spark):
    assert {r["path"]: r["event"] for r in changes.last_events(events(spark)).collect()} == {"/p1": "deleted", "/p2": "modified"}
    moves = spark.createDataFrame([(1, "/a", "/b", 5, "moved"), (2, "/c", None, 6, "modified")], "event_id int, path string, dest_path string, ts int, event string")
    assert sorted((r["path"], r["event"]) for r in changes.moved(moves).collect()) == [("/a", "deleted"), ("/b", "modified"), ("/c", "modified")]
    seen = spark.createDataFrame([("/d", "deleted", "plain", 1, 1.0, "h"), ("/i", "modified", "skip", 1, 1.0, "h"), ("/l", "modified", "plain", 1 << 40, 1.0, "h"), ("/s", "modified", "plain", 1, 1.0, "h"), ("/u", "modified", "plain", 2, 1.0, None), ("/k", "modified", "plain", 2, 1.0, "h"), ("/n", "modified", "plain", 2, 1.0, "new")], "path string, event string, route string, size bigint, mtime double, hash string")
    census = spark.createDataFrame([("/s", 1, 1.0)], "path string, size bigint, mtime double")
    got = {r["path"]: r["outcome"] for r in changes.change_outcomes(seen, census, spark.createDataFrame([("h",), ("h",), (None,)], "hash string")).collect()}
    assert got == {"/d": "deleted", "/i": "ignored", "/l": "too_large", "/s": "unchanged", "/u": "unreadable", "/k": "known_hash", "/n": "extract"}


def test_a_full_batch_is_handed_on_in_parts(spark, tmp_path):
    """More paths than one part holds: none is dropped, denied ones are counted, and a part that fails is recorded."""
    source = tmp_path / "in"
    rows = spark.createDataFrame([(f"/p{i:02}" + (".log" if i % 10 == 0 else ""), i, "modified") for i in range(40)], "path string, s int, event string")
    rows.select("path", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "event").coalesce(1).write.parquet(str(source))
    late = spark.createDataFrame([("/late", 5000, "modified")], "path string, s int, event string").select("path", F.timestamp_seconds("s").alias("ts"), "event")
    stream = spark.readStream.schema(late.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    late.coalesce(1).write.mode("append").parquet(str(source))
    got, watched = [], changes.Watched()

    def handle(part, batch):
        paths = [r["path"] for r in part.collect()]
        if "/p05" in paths:
            raise RuntimeError("bad")
        got.extend(paths)

    changes.watch(stream, handle, str(tmp_path / "check"), most_paths=8, seconds=None, deny=("*.log",), watched=watched).awaitTermination(120)
    assert watched.denied == 4 and len(watched.failed) == 1 and "/p05" not in got
    assert len(got) == len(set(got)) == watched.paths and 20 <= len(got) <= 35 and not any(p.endswith(".log") for p in got)
