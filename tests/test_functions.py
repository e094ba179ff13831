import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from archivolt.functions import globs, stemmer, text, vectors


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize("value, slug", [("Hello, World!", "hello-world"), ("Café", "caf"), ("---", "untitled"), ("", "untitled"), (None, "untitled"), ("a" * 70, "a" * 60), ("word " * 20, "-".join(["word"] * 12)[:59].rsplit("-", 1)[0] if False else "-".join(["word"] * 12))])
def test_slugify(spark, value, slug):
    assert one(spark, value, text.slugify) == slug


@pytest.mark.parametrize("value, terms", [('widget "service"', ["widget", "service"]), ("a bb  CC bb", ["bb", "CC", "bb"]), ("", []), ("x_y-z*", ["x_y"])])
def test_query_terms(spark, value, terms):
    assert one(spark, value, text.query_terms) == terms


@pytest.mark.parametrize("name, yes", [("README.md", True), ("Next.js", False), ("app.js", True), ("https://x.y", True), ("BSA/AML", False), ("src/app.py", True), ("PostgreSQL", False), (None, False), ("", False)])
def test_file_like(spark, name, yes):
    assert one(spark, name, text.is_file_like) is yes


@pytest.mark.parametrize("path", ["/a/b c/ü+1.pdf", "/x/100%.md", "/plain.txt"])
def test_uri_round_trip(spark, path):
    assert one(spark, path, lambda c: text.uri_path(text.file_uri(c))) == path


def test_error_class(spark):
    assert one(spark, "cannot open /Users/a b/c.pdf page 12 | other", text.error_class) == "cannot open <path> page N"
    assert one(spark, None, text.error_class) == "unknown"


def test_tokens_substance_and_markup(spark):
    assert [one(spark, "x" * n, text.estimate_tokens) for n in (0, 1, 367)] == [1, 1, 100]
    assert [one(spark, t, text.is_substantive) for t in ("```bash\n```", "---", "30", "abc", None)] == [False, False, False, True, False]
    assert one(spark, "<p>a &amp; b</p><script>x</script><!-- c -->d", text.without_markup) == "a & b\nd"


@pytest.mark.parametrize("glob", ["*.zip", "a?c", "*/x/*", "[ab]*.md", "[!a]b", ".git"])
def test_globs_match_like_the_shell(glob):
    for name in ["x.zip", "abc", "/q/x/y", "b1.md", "cb", ".git", "zip", "ab"]:
        assert bool(re.match(globs.glob_regex(glob), name)) == fnmatch.fnmatchcase(name, glob)


def test_denied_by(spark):
    paths = ["/a/node_modules/b.md", "/a/b.ZIP", "/home/Library/x", "/a/ok.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(globs.denied_by(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["node_modules", "*.zip", "*/Library/*", None]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("adjustable", "adjust"), ("controlling", "control"), ("sky", "sky"), ("is", "is")])
def test_porter(word, stem):
    assert stemmer.stem(word) == stem


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = rows.select(vectors.norm(F.col("a")), vectors.normalise(F.col("a")), vectors.dot(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == 5 and got[0][1] == pytest.approx([0.6, 0.8]) and got[0][2] == 24
    assert got[1][1] == [0, 0]
