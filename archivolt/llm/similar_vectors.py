"""Most similar vectors for every vector: a block matrix join.

Vectors are scaled to unit length and exact copies of one direction are folded
into a group, so that a direction shared by a third of all rows is one row of
the join. Pivots, a sample of the vectors, split the space into cells; every
vector goes to its ``probes`` nearest cells, as pivots are drawn from the data a
dense region gets many of them. Beyond ``most_pivots`` there are two levels: the
pivots of the first are held by every task, those of the second, drawn in
proportion to the data, are a table, and a vector meets those of its own cells
only, so that the work for a vector does not grow. A cell is a block of the matrix
join (a cell that holds more than ``split_rows``, as counted, becomes several
blocks, and each pair of its blocks a tile). Within a tile, vectors are quantised to int8 and multiplied; with the
exact residual norms of the quantisation, the product bounds the cosine from
above. Pairs whose bound reaches the similarity asked for are recomputed in
float, and heaps merge what the tiles found for each vector.

What is lost: a pair whose two vectors share no cell. With one cell (fewer than
about ``cell_rows`` vectors) the join is exact.

Results for odd input: vectors that are null, of the wrong width, all zero, or
hold a null, NaN or infinity take no part; nor do rows without chunk_id or of a
model without a width. A chunk written twice counts once, with the vector that
sorts first by digest if they differ. Similarities equal to six digits are
ordered by chunk_id; groups are numbered in that order, so that tiles and heaps
keep the right ones of equal similarity.
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, is_small, release

#: Rows that a cell should hold, and from which it is split into blocks.
CELL_ROWS, SPLIT_ROWS = 2048, 16384
#: Cells that each vector is put into; pivots of a model that every task holds at most, beyond which there are two levels.
PROBES, MAX_PIVOTS = 4, 16384
#: The same without a floor on the similarity, where neighbours are too unlike to share a cell as often.
FAR_PROBES, FAR_CELL_ROWS = 6, 3072
#: Steps of a unit within which two vectors are one direction.
DIRECTION = 1 << 21


def _unit(flat: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``flat`` scaled to length 1 as float32, and which rows are usable."""
    x = flat.astype(np.float64).reshape(-1, width)
    most = np.abs(x).max(axis=1, initial=0.0) if width else np.zeros(len(x))
    good = np.isfinite(most) & (most > 0)
    x = x[good] / most[good][:, None]
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x.astype(np.float32), good


def _digests(model: str, ways: np.ndarray) -> list[bytes]:
    """128 bits of each row of whole numbers, by two random linear forms of the model."""
    with np.errstate(over="ignore"):
        random = np.random.default_rng([*model.encode("utf-8", "replace"), ways.shape[1]])
        forms = random.integers(0, 1 << 63, size=(ways.shape[1] + 1, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sums = np.stack([(ways.astype(np.uint64) * forms[1:, i]).sum(axis=1) + forms[0, i] for i in (0, 1)], axis=1)
        sums = (sums ^ sums >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return [row.tobytes() for row in sums ^ sums >> np.uint64(32)]


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """model, chunk_id, dim, vector -> model, chunk_id, gid, vec for usable vectors."""
    for batch in batches:
        for width in set(batch.column("dim").to_pylist()):
            part = batch.filter(pc.equal(batch.column("dim"), width))
            flat = np.asarray(part.column("vector").flatten().to_numpy(zero_copy_only=False), dtype=np.float32)
            unit, good = _unit(flat, width)
            part = part.filter(pa.array(good))
            if not part.num_rows:
                continue
            vecs = [row.tobytes() for row in unit]
            ways = np.rint(unit * np.float32(DIRECTION)).astype(np.int64)
            models = np.array(part.column("model").to_pylist(), dtype=object)
            gids = np.empty(len(models), dtype=object)
            for m in set(models.tolist()):
                own = np.flatnonzero(models == m)
                gids[own] = _digests(m, ways[own])
            gids = gids.tolist()
            yield pa.RecordBatch.from_arrays([part.column("model").cast(pa.string()), part.column("chunk_id").cast(pa.string()), pa.array(gids, pa.binary()), pa.array(vecs, pa.binary())], ["model", "chunk_id", "gid", "vec"])


def usable_vectors(chunks: DataFrame, embedders: DataFrame) -> DataFrame:
    """model, chunk_id, gid (digest of model and direction), vec (unit vector, float32 bytes)."""
    widths = embedders.select("model", "dim").dropna().groupBy("model").agg(F.max("dim").cast("int").alias("dim"))
    rows = chunks.select("model", "chunk_id", F.col("vector").cast("array<float>").alias("vector")).join(widths, "model")
    rows = rows.filter(F.col("chunk_id").isNotNull() & (F.size("vector") == F.col("dim")) & (F.col("dim") > 0))
    return rows.select("model", "chunk_id", "dim", "vector").mapInArrow(_prepare, "model string, chunk_id string, gid binary, vec binary")


def _nearest_rows(x: np.ndarray, pivots: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the ``probes`` nearest of ``pivots`` for each row of ``x``; all rows share one cell where there are no more pivots."""
    if len(pivots) <= probes:
        return np.zeros((len(x), 1), dtype=np.int64)
    return np.argpartition(-(x @ pivots.T), probes - 1, axis=1)[:, :probes]


def _rows(vecs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(vecs.to_pylist()), dtype=np.float32).reshape(len(vecs), -1)


class _Router:
    """Sends vectors to the cells of their model's pivots, which every task holds."""

    def __init__(self, pivots: dict[str, np.ndarray], probes: int):
        self.pivots, self.probes, self.index = pivots, probes, {m: i for i, m in enumerate(sorted(pivots))}

    def _parts(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Rows of one model, with the row and the cell of each of their places."""
        for model in set(batch.column("model").to_pylist()) & set(self.pivots):
            part = batch.filter(pc.equal(batch.column("model"), model))
            x = _rows(part.column("vec"))
            for s in range(0, len(x), 4096):
                cells = _nearest_rows(x[s : s + 4096], self.pivots[model], self.probes)
                yield part, np.repeat(np.arange(s, s + len(cells)), cells.shape[1]), (self.index[model] << 32 | cells.ravel().astype(np.int64))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """model, id, vec -> cell, id, vec: each vector once for each of its cells."""
        for batch in batches:
            for part, rows, cells in self._parts(batch):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(cells), part.column("id").take(take), part.column("vec").take(take)], ["cell", "id", "vec"])

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """model, id, vec -> cell, n: how many vectors of the batch each cell gets."""
        for batch in batches:
            for _, _, cells in self._parts(batch):
                cell, n = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], ["cell", "n"])


def _second_level(probes: int):
    """Rows sorted by (cell, salt, id), a cell's pivots first as rows of negative id -> cells of the second level; one cell's pivots are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, pivots = None, [], np.zeros((0, 0), np.float32)
        for batch in batches:
            places = np.stack([batch.column("cell").to_numpy(), batch.column("salt").to_numpy().astype(np.int64)])
            ids, vecs = batch.column("id"), batch.column("vec")
            starts = [0, *(np.flatnonzero((np.diff(places) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(starts[:-1], starts[1:]):
                if e == s:
                    continue
                if tuple(places[:, s]) != current:
                    current, held, pivots = tuple(places[:, s]), [], None
                x, own = _rows(vecs.slice(s, e - s)), ids.slice(s, e - s).to_numpy()
                first = int((own < 0).sum())
                if first:
                    held.append(x[:first])
                    pivots = None
                if first == len(x):
                    continue
                if pivots is None:
                    pivots = np.concatenate(held) if held else np.zeros((0, x.shape[1]), np.float32)
                near = _nearest_rows(x[first:], pivots, probes)
                take = pa.array(np.repeat(np.arange(s + first, e), near.shape[1]))
                # the cell of the second level is known by the cell of the first and the pivot's number
                yield pa.RecordBatch.from_arrays([pa.array(np.full(near.size, current[0])), pa.array(near.ravel().astype(np.int32)), ids.take(take), vecs.take(take)], ["cell", "part", "id", "vec"])

    return run


def _quantise(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """int8 codes of ``x`` under one scale, the scale, and the exact norm of each row's residual."""
    scale = float(np.abs(x).max()) / 127 or 1.0
    codes = np.rint(x / scale).astype(np.int8)
    rest = x - codes * np.float32(scale)
    return codes, scale, np.sqrt(np.einsum("ij,ij->i", rest, rest, dtype=np.float64))


def _kth_at_least(dots: np.ndarray, k: int, groups: int = 128) -> np.ndarray:
    """A value for each row that its ``k``-th largest entry reaches: the ``k``-th largest of the
    greatest entries of disjoint groups of columns, or the entry itself where columns are few."""
    deep = dots.shape[1] // groups
    if deep > 1 and groups > 8 * k:
        dots = dots[:, : deep * groups].reshape(len(dots), deep, groups).max(axis=1)
    return np.partition(dots, -k, axis=1)[:, -k]


def tile_neighbours(x: np.ndarray, y: np.ndarray | None, k: int, least: float, step: int = 1024, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``x`` and of ``y`` its ``k`` most similar rows on the other
    side, or within ``x`` where ``y`` is None, of cosine ``least`` or more:
    (row, other row, cosine); rows of ``y`` are numbered after those of ``x``. Of
    cosines equal to six digits the one of the least of ``ids`` comes first."""
    both = x if y is None else np.concatenate([x, y])
    n = len(both)
    codes, scale, rest = _quantise(both)
    side = codes.astype(np.float32)  # int8 products are exact in float32 up to 1,040 columns
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    slack = 1e-5
    norm = 1 + rest.max(initial=0.0)
    sides = [(0, n, 0, n)] if y is None else [(0, len(x), len(x), n), (len(x), n, 0, len(x))]
    for a, a_to, b_from, b_to in ((a, min(a + step, end), b_from, b_to) for start, end, b_from, b_to in sides for a in range(start, end, step)):
        rows = np.arange(a, a_to)
        dots = side[a:a_to] @ side[b_from:b_to].T
        dots *= np.float32(scale * scale)
        if y is None:
            dots[np.arange(len(rows)), rows] = -9.0
        bound = rest[a:a_to, None] * norm + rest[None, b_from:b_to].max(initial=0.0) * norm + slack
        cut = np.full((len(rows), 1), least)
        if dots.shape[1] > k:
            sure = _kth_at_least(dots, k)[:, None] - bound if least <= 0 or dots.shape[1] <= 8 * k else None
            if sure is not None:
                cut = np.maximum(cut, sure)
        i, j = np.divmod(np.flatnonzero((dots >= (cut - bound).astype(np.float32)).ravel()), dots.shape[1])
        if len(i) > 64 * k * len(rows) and dots.shape[1] > k:  # a dense tile: cut each row at its k-th sure cosine
            sure = np.partition(dots, -k, axis=1)[:, -k][:, None] - bound
            i, j = np.divmod(np.flatnonzero((dots >= (np.maximum(cut, sure) - bound).astype(np.float32)).ravel()), dots.shape[1])
        keep = dots[i, j] > -5
        i, j = i[keep] + a, j[keep] + b_from
        for s in range(0, len(i), 1 << 17):  # survivors, in float
            p, q = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
            cos = np.einsum("ij,ij->i", both[p].astype(np.float64), both[q].astype(np.float64))
            ok = cos >= least
            out.append((p[ok], q[ok], cos[ok]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    i, j, cos = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((-cos, i)) if ids is None else np.lexsort((ids[j], -np.round(cos, 6), i))
    i, j, cos = i[order], j[order], cos[order]
    first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
    at = np.arange(len(i))
    rank = at - np.maximum.accumulate(np.where(first, at, 0))
    top = rank < k
    return i[top], j[top], cos[top]


def _tile(k: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        ids = table.column("id").to_numpy()
        x = _rows(table.column("vec"))
        if low == high:
            i, j, cos = tile_neighbours(x, None, k, least, ids=ids)
        else:
            left = table.column("block").to_numpy() == low
            order = np.r_[np.flatnonzero(left), np.flatnonzero(~left)]
            ids, x = ids[order], x[order]
            n = int(left.sum())
            i, j, cos = tile_neighbours(x[:n], x[n:], k, least, ids=ids)
        return pa.table({"a": pa.array(ids[i], pa.int64()), "b": pa.array(ids[j], pa.int64()), "similarity": pa.array(cos, pa.float64())})

    return run


def _merge_heaps(k: int):
    """Candidates sorted by ``a`` -> the k best of each ``a``; one heap is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple[float, int]] = []  # cosine to six digits, and the negative id
        held: dict[int, float] = {}
        current = None
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            for _, b in sorted(heap, reverse=True):
                out[0].append(current), out[1].append(-b), out[2].append(held[-b])

        for batch in batches:
            for a, b, cos in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("similarity").to_pylist()):
                if a != current:
                    close()
                    current, heap, held = a, [], {}
                if b in held:
                    continue
                entry = (round(cos, 6), -b)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    del held[-heapq.heapreplace(heap, entry)[1]]
                else:
                    continue
                held[b] = cos
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["a", "b", "similarity"])
                out = ([], [], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["a", "b", "similarity"])

    return run


def draw_pivots(vectors: DataFrame, wanted: dict[str, int], counts: dict[str, int]) -> dict[str, np.ndarray]:
    """About ``wanted`` of each model's vectors (model, id, vec), chosen by a hash of the vector."""
    at = F.pmod(F.xxhash64("vec", F.lit(11)), F.lit(1 << 30))
    share = F.lit(0)
    for m, n in counts.items():
        share = F.when(F.col("model") == m, F.lit(int((1 << 30) * min(1.0, (1.2 * wanted[m] + 40) / n)) + 1)).otherwise(share)
    drawn: dict[str, list[bytes]] = {m: [] for m in counts}
    for r in vectors.filter(at < share).select("model", "vec", at.alias("at")).orderBy("at").collect():
        if len(drawn[r["model"]]) < wanted[r["model"]]:
            drawn[r["model"]].append(bytes(r["vec"]))
    return {m: np.stack([np.frombuffer(v, dtype=np.float32) for v in vecs]) if vecs else np.zeros((0, 0), np.float32) for m, vecs in drawn.items()}


def cells_of(vectors: DataFrame, probes: int, cell_rows: int, most_pivots: int) -> tuple[DataFrame, DataFrame]:
    """(cell, part, id, vec): each of ``vectors`` (model, id, vec) once for each of its cells; and (cell, part, n): their sizes."""
    counts = {r["model"]: r["n"] for r in vectors.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {m: max(1, math.ceil(n * probes / cell_rows)) for m, n in counts.items()}
    deep = any(n > most_pivots for n in wanted.values())
    first = {m: min(n, most_pivots) if not deep else max(1, min(most_pivots, math.ceil(math.sqrt(n)))) for m, n in wanted.items()}
    outer = 2 if deep and probes > 1 else probes  # of two levels each gets its share of the probes
    router = _Router(draw_pivots(vectors, first, counts), outer)
    if not deep:
        sizes = vectors.mapInArrow(router.count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        return vectors.mapInArrow(router, "cell long, id long, vec binary").withColumn("part", F.lit(0)), sizes.withColumn("part", F.lit(0))
    # pivots of the second level: as many as keep the cells at their size, each within its own nearest cell
    share = F.lit(0.0)
    for m, n in counts.items():
        share = F.when(F.col("model") == m, F.lit(min(1.0, wanted[m] / n / outer))).otherwise(share)
    drawn = vectors.filter(F.pmod(F.xxhash64("vec", F.lit(13)), F.lit(1 << 30)) < share * F.lit(1 << 30))
    pivots = drawn.mapInArrow(_Router(router.pivots, 1 if outer == 1 else outer), "cell long, id long, vec binary").select("cell", "id", "vec")
    # a cell of many rows is routed by several tasks
    salts = 16
    rows = vectors.mapInArrow(router, "cell long, id long, vec binary").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    pivots = pivots.select("cell", (-F.col("id") - 1).alias("id"), "vec", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    both = rows.unionByName(pivots).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "id")
    cells = cut(both.mapInArrow(_second_level(max(1, probes // outer)), "cell long, part int, id long, vec binary"))
    return cells, cells.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"))


def similar_vectors(
    chunks: DataFrame, embedders: DataFrame, k: int = 5, min_similarity: float = 0.9, probes: int = PROBES, cell_rows: int = CELL_ROWS, split_rows: int = SPLIT_ROWS, most_pivots: int = MAX_PIVOTS
) -> DataFrame:
    """chunk_id, neighbour_id, similarity, rank: the ``k`` most similar other
    chunks of the same model, of cosine ``min_similarity`` or more."""
    usable = cut(usable_vectors(chunks, embedders))
    member = cut(usable.groupBy("model", "chunk_id").agg(F.min("gid").alias("gid")).select("gid", "chunk_id"))
    group = Window.partitionBy("gid").orderBy("chunk_id")
    heads = member.withColumn("position", F.row_number().over(group)).filter(F.col("position") <= k + 1)
    heads = heads.groupBy("gid").agg(F.array_sort(F.collect_list("chunk_id")).alias("heads"))
    heads = cut(heads.orderBy(F.col("heads")[0]).withColumn("id", F.monotonically_increasing_id()))
    vectors = usable.groupBy("gid").agg(F.first("model").alias("model"), F.first("vec").alias("vec"))
    vectors = cut(vectors.join(heads.select("gid", "id"), "gid").select("model", "id", "vec"))
    release(usable)

    cells, sizes = cells_of(vectors, probes, cell_rows, most_pivots)
    large = cut(sizes.filter(F.col("n") > split_rows).select("cell", "part", F.ceil(F.col("n") / split_rows).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    tiles = cells.join(F.broadcast(large) if is_small(large) else large, ["cell", "part"], "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = tiles.select("cell", "part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "vec")
    found = tiles.groupBy("cell", "part", "low", "high").applyInArrow(_tile(k, min_similarity), "a long, b long, similarity double")
    best = found.repartition("a").sortWithinPartitions("a").mapInArrow(_merge_heaps(k), "a long, b long, similarity double")

    # Copies of one direction are each other's nearest; a group of more than k fills its members' ranks.
    left = member.join(heads, "gid")
    own = left.filter(F.size("heads") > 1).select("chunk_id", F.explode("heads").alias("neighbour_id"), F.lit(1.0).alias("similarity"))
    across = best.join(heads.select(F.col("id").alias("b"), "heads"), "b").select(F.col("a").alias("id"), F.slice("heads", 1, k).alias("others"), "similarity")
    across = left.filter(F.size("heads") <= k).select("id", "chunk_id").join(across, "id").select("chunk_id", F.explode("others").alias("neighbour_id"), F.least("similarity", F.lit(1.0)).alias("similarity"))
    if min_similarity > 1:
        own = own.limit(0)
    every = own.unionByName(across).filter(F.col("chunk_id") != F.col("neighbour_id"))
    order = Window.partitionBy("chunk_id").orderBy(F.desc(F.round("similarity", 6)), "neighbour_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_vectors(chunks: DataFrame, embedders: DataFrame, k: int = 5, probes: int = FAR_PROBES, cell_rows: int = FAR_CELL_ROWS, split_rows: int = SPLIT_ROWS, most_pivots: int = MAX_PIVOTS) -> DataFrame:
    """As :func:`similar_vectors` without a floor: every chunk gets ``k`` neighbours if its model has so many others."""
    return similar_vectors(chunks, embedders, k, -1.0, probes, cell_rows, split_rows, most_pivots)


def similar_pairs(chunks: DataFrame, embedders: DataFrame, k: int = 5, min_similarity: float = 0.9, **options: int) -> DataFrame:
    """chunk_a < chunk_b: distinct pairs of which one is among the k most similar of the other."""
    rows = similar_vectors(chunks, embedders, k, min_similarity, **options)
    return rows.select(F.least("chunk_id", "neighbour_id").alias("chunk_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_b")).distinct()
