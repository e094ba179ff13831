import pytest
from pyspark.sql import functions as F

from archivolt.operators import orphans

REFS = [(1, "a", "x"), (2, "a", None), (3, None, "y"), (4, None, None), (5, "b", "y"), (6, "c", "z"), (7, "c", None), (8, "a", "x")]
KEYS = [("a", "x"), ("b", "y"), ("b", "y"), (None, "q"), ("d", None)]


def brute(match):
    out = []
    for i, p, q in REFS:
        if p is None and q is None:
            continue
        if p is not None and q is not None:
            bad = (p, q) not in KEYS
        elif match == "simple":
            bad = False
        elif match == "full":
            bad = True
        else:
            bad = not any((p is None or k[0] == p) and (q is None or k[1] == q) for k in KEYS)
        if bad:
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("match", orphans.MATCHES)
def test_masks_against_brute_force(spark, match):
    refs = spark.createDataFrame(REFS, "id int, p string, q string").withColumn("extra", F.lit(1))
    keys = spark.createDataFrame(KEYS, "p string, q string").withColumn("extra", F.lit(2))
    got = orphans.orphan_references(refs, ["p", "q"], keys, ["p", "q"], match)
    assert sorted(r["id"] for r in got.collect()) == brute(match)
    assert got.columns == ["id", "p", "q", "extra"]


def test_empty_tables_and_bad_arguments(spark):
    refs = spark.createDataFrame(REFS, "id int, p string, q string")
    none = spark.createDataFrame([], "p string, q string")
    assert sorted(r["id"] for r in orphans.orphan_references(refs, ["p", "q"], none, ["p", "q"]).collect()) == [1, 5, 6, 8]
    assert orphans.orphan_references(refs.limit(0), ["p"], none, ["p"]).count() == 0
    with pytest.raises(ValueError):
        orphans.orphan_references(refs, ["p"], none, ["p"], "some")
    with pytest.raises(ValueError):
        orphans.orphan_references(refs, ["p"], none, ["p", "q"])


@pytest.mark.parametrize(
    "target, meant",
    [("/a/b.md", "a/b"), ("../c/d.md#x", "c/d"), ("./e.md?v=1", "dir/e"), ("e.md", "dir/e"), ("../../x.md", "../x"), ("http://a/b.md", None), ("mailto:a.md", None), ("#a.md", None), ("pic.png", None), ("/A/B.md", "A/B"), (None, None), ("/a/./b/../c.md", "a/c")],
)
def test_link_targets(spark, target, meant):
    rows = spark.createDataFrame([("dir/from", target)], "f string, t string")
    assert rows.select(orphans.link_concept(F.col("f"), F.col("t"))).first()[0] == meant


def test_live_hashes_take_the_latest_instant(spark):
    files = spark.createDataFrame(
        [("p", "H1", "included", "2024-01-01T12:00:00+02:00"), ("p", "h2", "included", "2024-01-01T11:00:00Z"), ("q", " blake3:H3\n", "included", "2024-01-01T00:00:00Z"), ("r", "h4", "missing", "2024-01-01T00:00:00Z"), ("s", None, "included", "2024-01-01T00:00:00Z")],
        "path string, hash string, scan_status string, last_seen string",
    )
    assert sorted(r[0] for r in orphans.live_hashes(files).collect()) == ["h2", "h3"]


def test_hot_key_is_counted_whole(spark):
    refs = spark.range(3000).select("id", F.when(F.col("id") < 1000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    keys = spark.createDataFrame([("cold",)], "k string")
    assert orphans.orphan_references(refs, ["k"], keys, ["k"]).count() == 3000
