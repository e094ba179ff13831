import numpy as np
import pytest

from archivolt.llm import similar_vectors as sv

SCHEMA = "model string, chunk_id string, vector array<float>, extra int"


def brute(rows, dims, k, least):
    best = {}
    for m, c, v, _ in rows:
        if c is not None and m in dims and v is not None and len(v) == dims[m] and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[m, c] = np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64))
    out = set()
    for (m, a), x in best.items():
        near = sorted((-round(float(x @ y), 6), b) for (n, b), y in best.items() if n == m and b != a)[:k]
        out |= {(min(a, b), max(a, b)) for s, b in near if -s >= least}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    rows = [("m", f"c{i:03}", (base[i % 30] + 0.12 * rng.normal(size=16)).astype(np.float32).tolist(), i) for i in range(150)]
    rows += [("m", f"copy{i}", (base[0] * (i + 1)).astype(np.float32).tolist(), i) for i in range(12)]  # one direction, many lengths
    rows += [("n", f"c{i:03}", rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(10)]
    rows += rows[:5]
    rows += [("m", "null", None, 0), ("m", "short", [1.0], 0), ("m", "zero", [0.0] * 16, 0), ("m", "nan", [float("nan")] * 16, 0), ("m", "inf", [float("inf")] + [1.0] * 15, 0), ("m", "hole", [None] + [1.0] * 15, 0), ("m", None, [1.0] * 16, 0), ("q", "nowidth", [1.0] * 16, 0), (None, "nomodel", [1.0] * 16, 0)]
    return rows


def pairs(spark, rows, **options):
    chunks = spark.createDataFrame(rows, SCHEMA)
    embedders = spark.createDataFrame([("m", 16), ("n", 8), ("m", 16), (None, 3)], "model string, dim int")
    return {tuple(r) for r in sv.similar_pairs(chunks, embedders, **options).collect()}


def test_exact_with_one_cell(spark, rows):
    assert pairs(spark, rows) == brute(rows, {"m": 16, "n": 8}, 5, 0.9)


def test_cells_and_split_blocks_keep_recall(spark, rows):
    want = brute(rows, {"m": 16, "n": 8}, 5, 0.9)
    got = pairs(spark, rows, probes=4, cell_rows=40, split_rows=16)
    assert len(got & want) >= 0.9 * len(want) and not any(p for p in got - want if "copy" not in p[0] + p[1])


def test_empty_tables(spark, rows):
    assert pairs(spark, []) == set()
    none = spark.createDataFrame([], "model string, dim int")
    assert sv.similar_pairs(spark.createDataFrame(rows, SCHEMA), none).count() == 0


@pytest.mark.parametrize("least", [-1.0, 0.5])
def test_tile_bounds_lose_nothing(least):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    for y in (None, x[200:]):
        left = x if y is None else x[:200]
        i, j, cos = sv.tile_neighbours(left, y, 3, least, step=64)
        both = x.astype(np.float64) @ x.astype(np.float64).T
        for r in range(300):
            others = [c for c in range(300) if c != r and (y is None or (c < 200) != (r < 200))]
            want = sorted((both[r, c] for c in others if both[r, c] >= least), reverse=True)[:3]
            assert np.allclose(sorted(cos[i == r], reverse=True), want, atol=1e-6)


def test_nearest_vectors_give_every_chunk_its_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    rows = [("m", f"c{i:04}", v.tolist(), 0) for i, v in enumerate(x)]
    chunks = spark.createDataFrame(rows, SCHEMA)
    got = sv.nearest_vectors(chunks, spark.createDataFrame([("m", 16)], "model string, dim int"), cell_rows=512).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T
    np.fill_diagonal(near, -9)
    want = {(f"c{i:04}", f"c{j:04}") for i, row in enumerate(np.argsort(-near, axis=1)[:, :5]) for j in row}
    assert len(got) == 5 * len(rows) and len({(r["chunk_id"], r["neighbour_id"]) for r in got} & want) >= 0.9 * len(want)


def test_the_registered_query_of_neighbours_has_no_floor(spark, tmp_path):
    from archivolt.llm.queries import QUERIES

    far = np.eye(16, dtype=np.float32)
    spark.createDataFrame([("m", f"c{i:02}", v.tolist(), 0) for i, v in enumerate(far)], SCHEMA).write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([("m", 16)], "model string, dim int").write.parquet(str(tmp_path / "embedders.parquet"))
    assert QUERIES["p1_neighbours"](spark, str(tmp_path)).groupBy("chunk_id").count().filter("count = 5").count() == 16


def test_ties_at_the_last_rank_go_by_chunk_id(spark):
    rows = [("m", "a", [1.0, 0.0, 0.0], 0)] + [("m", f"z{i:02}", [0.5, 1.0 + i * 2e-7, i * 2e-5], 0) for i in range(40)]
    chunks = spark.createDataFrame(rows, SCHEMA)
    got = sv.nearest_vectors(chunks, spark.createDataFrame([("m", 3)], "model string, dim int")).filter("chunk_id = 'a'").collect()
    unit = {c: np.array(v) / np.linalg.norm(v) for _, c, v, _ in rows}
    want = sorted((-round(float(unit["a"] @ unit[c]), 6), c) for c in unit if c != "a")[:5]
    assert {r["neighbour_id"] for r in got} == {c for _, c in want}


def test_two_levels_of_pivots_keep_recall(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 16))
    x = (base[np.arange(3000) % 150] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [("m", f"c{i:04}", v.tolist(), 0) for i, v in enumerate(x)]
    got = sv.nearest_vectors(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("m", 16)], "model string, dim int"), cell_rows=256, most_pivots=32, split_rows=400).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T
    np.fill_diagonal(near, -9)
    want = {(f"c{i:04}", f"c{j:04}") for i, row in enumerate(np.argsort(-near, axis=1)[:, :5]) for j in row}
    assert len(got) == 5 * len(rows) and len({(r["chunk_id"], r["neighbour_id"]) for r in got} & want) >= 0.9 * len(want)
