from hypothesis import given, settings
from hypothesis import strategies as st

from archivolt.sources import frontmatter as fm

SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-10**9, 10**9), st.text(max_size=30), st.sampled_from(["yes", "no", "null", "1.5", "- x", "a: b", "a #b", "#", "'", '"', "[x", "{", "|", "", " x", "é", "x:", "\n", "a\n\nb", "---"]))
KEYS = st.text(min_size=1, max_size=12)
VALUES = st.recursive(SCALARS, lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(KEYS, inner, max_size=4)), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(KEYS, VALUES, min_size=1, max_size=5), st.text(max_size=60))
def test_round_trip(front, body):
    assert fm.parse(fm.render(front, body)) == (front, body)


def test_what_people_write():
    text = """---
# a comment
title: "Weekly: notes"   # trailing
tags: [a, 'b c', "d,e"]
people:
- name: Ada
  kind: person
- name: Bea
nested:
  deep:
    list:
      - 1
      - 2.5
      - true
text: |
  one
  two
folded: >-
  one
  two
empty:
map: {a: 1, b: [x, y]}
url: https://x.org/a#b
---
body
"""
    front, body = fm.parse(text)
    assert body == "body\n" and front == {
        "title": "Weekly: notes", "tags": ["a", "b c", "d,e"], "people": [{"name": "Ada", "kind": "person"}, {"name": "Bea"}], "nested": {"deep": {"list": [1, 2.5, True]}},
        "text": "one\ntwo\n", "folded": "one two", "empty": None, "map": {"a": 1, "b": ["x", "y"]}, "url": "https://x.org/a#b",
    }


def test_unreadable_blocks():
    assert all(fm.parse(t) is None for t in (None, "", "no block", "---\nopen", "---\n- a list\n---\n", "---\n\tx: 1\n---\n", "---\njust text\n---\n", "---\na: [1\n---\n", "---\na: &x 1\n---\n", "---\na: 1\n   b: 2\n---\n"))
    assert fm.parse("---\n---\nx") is None


def test_lookup(spark):
    docs = spark.createDataFrame([("a/x.md", fm.render({"type": "T", "tags": ["p", "q"]}, "b")), ("a/y.md", "none"), ("a/z.md", "---\nq: 1\n---\n")], "path string, text string")
    ids = spark.createDataFrame([("a/x",), ("a/y",), ("a/w",), ("a/x",)], "concept_id string")
    assert {r["concept_id"]: r["front"] for r in fm.frontmatter_of(docs, ids).collect()} == {"a/x": '{"type": "T", "tags": ["p", "q"]}', "a/y": None, "a/w": None}
    assert fm.parsed(docs.limit(0)).count() == 0
