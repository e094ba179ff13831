import random

import numpy as np
import pytest

from archivolt.llm import set_pairs as sp


def brute(sets, least):
    items = sorted((k, v) for k, v in sets.items() if v)
    return {(a, b) for i, (a, x) in enumerate(items) for b, y in items[i + 1 :] if len(x & y) / len(x | y) >= least}


def families(n, seed):
    rng = random.Random(seed)
    sets = {}
    for i in range(n):
        own = {f"t{rng.randrange(60)}" for _ in range(rng.randint(1, 8))} | {"hot"} if i % 3 else {f"f{i // 9}.{j}" for j in range(8)} - {f"f{i // 9}.{i % 8}"}
        sets[f"r{i:03}"] = own
    return sets


@pytest.fixture(scope="module")
def members(spark):
    sets = families(240, 3)
    rows = [(k, m, 1) for k, v in sets.items() for m in v] + [("r000", None, 1), (None, "t1", 1)] + [(k, m, 1) for k, v in list(sets.items())[:9] for m in v]
    return sets, spark.createDataFrame(rows, "id string, member string, extra int")


@pytest.mark.parametrize("options", [{}, {"node_rows": 20, "levels": 1}, {"node_rows": 15, "levels": 0}])
def test_against_brute_force(spark, members, options):
    sets, rows = members
    want = brute(sets, 0.6)
    got = {(r["id_a"], r["id_b"]) for r in sp.similar_records(rows, "id", **options).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_classes(spark, members):
    sets, rows = members
    got = sp.record_classes(rows, "id").collect()
    assert len(got) == len([v for v in sets.values() if v]) and len({r["class_id"] for r in got}) == len({frozenset(v) for v in sets.values()})


def test_concept_sets(spark):
    rows = [("a", '["X  y", " x Y", null, ""]', '[{"name": " Bob  B", "kind": "Person"}, {"name": null, "kind": "person"}, {"name": "", "kind": "person"}]'), ("b", None, None), ("c", "not json", "[]"), (None, '["z"]', None), ("a", '["z"]', None)]
    got = sp.concept_sets(spark.createDataFrame(rows, "concept_id string, tags string, entities string"))
    assert sorted(map(tuple, got.collect())) == [("a", "person:bob b"), ("a", "x y"), ("a", "z")]
    assert sp.similar_records(got.limit(0), "concept_id").count() == 0


def test_nodes_recurse_and_verify():
    rng = random.Random(1)
    sets = [np.array(sorted({rng.randrange(40) for _ in range(10)} | {1000}), dtype=np.int64) for _ in range(300)]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.6}
    got = set()
    for seed in range(12):
        got |= {(min(i, j), max(i, j)) for i, j, _, _ in sp.node_pairs(sets, seed, 0.6, brute=40, depth=3)}
    assert got <= want and len(got) >= 0.95 * len(want)


def together(a, b, path, threshold, depth):
    """Whether two sets share a node after ``depth`` splits of one tree, by the hashes and the rule of the operator."""
    if not depth:
        return True
    for t in np.intersect1d(a, b).tolist():
        one = np.array([t], dtype=np.int64)
        if (sp._mix(one, path) < 1 / (threshold * max(len(a), len(b)))).all():
            if together(a, b, (path * 6364136223846793005 + t * 2 + 1) & (1 << 64) - 1, threshold, depth - 1):
                return True
    return False


@pytest.mark.parametrize("depth", [3, 7, 8])
def test_trees_reach_the_recall_at_the_threshold(depth):
    """Nested sets of Jaccard similarity exactly 0.6, kept in large nodes down to the depth."""
    rng = np.random.default_rng(depth)
    trees = sp.trees_for(0.95, depth)
    kept = 0
    for _ in range(300):
        b = rng.integers(0, 1 << 60, 10)
        kept += any(together(b[:6], b, seed, 0.6, depth) for seed in range(trees))
    assert kept >= 0.93 * 300 and trees <= 20
    assert [sp.trees_for(r, 7) for r in (0.5, 0.9, 0.95, 0.99)] == sorted(sp.trees_for(r, 7) for r in (0.5, 0.9, 0.95, 0.99))


def test_the_root_is_exact(spark, members):
    """Pairs that share a rare token do not depend on the trees."""
    sets, rows = members
    got = {(r["id_a"], r["id_b"]) for r in sp.similar_records(rows, "id", recall=0.01).collect()}
    assert got == brute(sets, 0.6)


@pytest.mark.parametrize("options", [{}, {"node_rows": 120}, {"node_rows": 25, "levels": 1}, {"node_rows": 25}, {"node_rows": 40, "levels": 0}, {"node_rows": 20, "levels": 4}])
def test_sets_of_frequent_members_only(spark, options):
    rng = random.Random(9)
    sets = {f"r{i:04}": {f"t{int(rng.random() ** 2 * 22)}" for _ in range(rng.choice((1, 2, 2, 3, 5, 8, 12)))} for i in range(900)}
    want = brute(sets, 0.6)
    rows = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()] + [("r0000", [None]), ("r0001", None), ("r0002", []), (None, ["t1"])], "id string, members array<string>")
    got = [(r["id_a"], r["id_b"]) for r in sp.similar_records(rows, "id", "members", rare=0, **options).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.95 * len(want)
    assert options.get("levels") != 0 or len(got) == len(want)


def test_a_member_of_all_rows_parts_nothing(monkeypatch):
    """A node is not compared as a whole because all its sets share some tokens."""
    rng = np.random.default_rng(2)
    sets = [np.unique(np.r_[1, 2, rng.integers(10, 2000, 8)]) for _ in range(1500)]
    sizes, compare = [], sp.brute_pairs
    monkeypatch.setattr(sp, "brute_pairs", lambda rows, *rest: sizes.append(len(rows)) or compare(rows, *rest))
    for seed in range(20):
        list(sp.node_pairs(sets, seed, 0.6))
    assert max(sizes) < 500


def test_lists_are_the_same_sets(spark):
    rows = [("a", '["X  y", " x Y", null, ""]', '[{"name": " Bob  B", "kind": "Person"}]'), ("b", '["x y", "q"]', None), ("b", '["q", "x y"]', '[{"name": "bob b", "kind": "person"}]'), ("c", None, None)]
    table = spark.createDataFrame(rows, "concept_id string, tags string, entities string")
    want = sorted(map(tuple, sp.similar_records(sp.concept_sets(table), "concept_id").collect()))
    assert sorted(map(tuple, sp.similar_records(sp.concept_lists(table), "concept_id", "members").collect())) == want and [w[:2] for w in want] == [("a", "b")]
