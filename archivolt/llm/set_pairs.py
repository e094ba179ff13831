"""All similar pairs between set-valued records, by recursive chosen-path splitting.

Records with the same set are one class. At the root a class is put into the nodes
of its first n - needed + 1 tokens, in an order of all tokens that has the rare ones
first and then the frequent ones by their number: of two similar sets, the larger of
n tokens, ``needed`` = threshold * n tokens or more are shared, so that the first
token they share is among these of both. The root is thus exact and made once; the
node of a rare token is small and compared by brute force.

Nodes of frequent tokens are split again until they are small: a token of a set that
needs m more shared tokens is chosen where its hash, under the node's path, is below
1 / m, so that two sets share a chosen token at each level with about the chance
that keeps similar pairs together (1 expected shared child or more at the threshold)
and parts others; a token that is on the path, or that all rows of a node have,
parts nothing and is not chosen. A small node is compared by brute force. Nodes too
large for one task are split by further levels on the cluster, and what is still too
large after ``levels`` of them is cut into blocks whose pairs are compared tile by
tile, so no node is dropped or capped. Every reported pair is verified on the whole
sets.

Below the root, repeated trees reach the recall: two sets at the threshold share one
child a level on average, so that they stay together through d levels with the
chance that a critical branching process survives d generations, at least; the
number of trees is what the ``recall`` asked for needs at the greatest depth.

Results for odd input: null sets, null members and members that are empty after
cleaning are dropped; an empty set makes no pair. Rows of one id are united.
Rows with a null id make no pair. Empty tables give no rows. Sets are compared
by 64-bit hashes of their members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..session import cut, is_small

#: Share of the pairs at the threshold to be found, the size of a node that is compared by brute force, levels within a task.
RECALL, BRUTE, DEPTH = 0.95, 96, 4
#: Rows of a node that one task may hold, and further levels on the cluster before it is tiled.
NODE_ROWS, LEVELS = 8192, 2

_UNIT = 1 << 30
_PAIRS = "a binary, b binary, shared int, united int"


def trees_for(recall: float, depth: int) -> int:
    """Trees that find a pair at the threshold with probability ``recall`` if each splits ``depth`` times."""
    gone = 0.0  # a pair's chance to be parted, each level having one shared child on average
    for _ in range(depth):
        gone = math.exp(gone - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(gone))) if gone else 1


def clean_member(column: Column) -> Column:
    """Case-folded, white space trimmed and collapsed."""
    return F.replace(F.lower(F.trim(F.regexp_replace(column, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def concept_lists(concepts: DataFrame) -> DataFrame:
    """concept_id, members: the tags and entity keys of each row, as a list."""
    tags = F.from_json("tags", "array<string>")
    entities = F.from_json("entities", "array<struct<name:string,kind:string>>")
    keys = F.transform(F.filter(entities, lambda e: e["name"].isNotNull()), lambda e: F.concat(F.lower(F.coalesce(e["kind"], F.lit(""))), F.lit(":"), clean_member(e["name"])))
    members = F.concat(F.transform(F.coalesce(tags, F.array().cast("array<string>")), clean_member), F.coalesce(keys, F.array().cast("array<string>")))
    kept = F.filter(members, lambda m: m.isNotNull() & (m != "") & ~F.endswith(m, F.lit(":")))
    return concepts.filter(F.col("concept_id").isNotNull()).select("concept_id", kept.alias("members"))


def concept_sets(concepts: DataFrame) -> DataFrame:
    """concept_id, member: the tags and entity keys of each concept, distinct."""
    return concept_lists(concepts).select("concept_id", F.explode("members").alias("member")).distinct()


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of 64-bit tokens under a seed, as numbers in [0, 1)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) ^ np.uint64(seed & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) / float(1 << 53)


def brute_pairs(sets: list[np.ndarray], split: int | None, threshold: float, step: int = 1024) -> Iterator[tuple[int, int, int, int]]:
    """Pairs (i, j, shared, united) of similar sets; with ``split`` only those of one before and one from ``split`` on."""
    n = len(sets)
    if n <= 8 and split is None:
        own = [frozenset(s.tolist()) for s in sets]
        for i, j in combinations(range(n), 2):
            a, b = own[i], own[j]
            shared = len(a & b)
            if shared and shared / (len(a) + len(b) - shared) >= threshold - 1e-12:
                yield i, j, shared, len(a) + len(b) - shared
        return
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    tokens, where, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times > 1  # a token of one set is in no intersection
    column = np.cumsum(common) - 1
    row = np.repeat(np.arange(n), sizes)
    kept = common[where]
    width = int(common.sum())
    if not width:
        return
    row, col = row[kept], column[where[kept]]
    order = np.argsort(row, kind="stable")
    row, col = row[order], col[order]
    bounds = np.searchsorted(row, np.arange(n + 1))

    def dense(a: int, b: int) -> np.ndarray:
        m = np.zeros((b - a, width), dtype=np.float32)
        m[row[bounds[a] : bounds[b]] - a, col[bounds[a] : bounds[b]]] = 1
        return m

    step = max(64, min(step, 8_000_000 // width))
    for a in range(0, n, step):
        left = dense(a, min(n, a + step))
        for b in range(a, n, step):
            shared = left @ (left if a == b else dense(b, min(n, b + step))).T
            united = sizes[a : a + step, None] + sizes[None, b : b + step] - shared
            i, j = np.nonzero(shared >= (threshold - 1e-12) * united)
            i, j, at = i + a, j + b, (i, j)
            keep = (i < j) & (True if split is None else (i < split) & (j >= split))
            yield from zip(i[keep].tolist(), j[keep].tolist(), shared[at][keep].astype(int).tolist(), united[at][keep].astype(int).tolist())


def node_pairs(sets: list[np.ndarray], seed: int, threshold: float, brute: int = BRUTE, depth: int = DEPTH) -> Iterator[tuple[int, int, int, int]]:
    """Similar pairs of one node: split by chosen tokens until small; at the last depth all are compared."""
    stack = [(np.arange(len(sets)), seed, depth)]
    while stack:
        rows, path, left = stack.pop()
        if len(rows) < 2:
            continue
        if len(rows) <= brute or not left:
            for i, j, shared, united in brute_pairs([sets[r] for r in rows], None, threshold):
                yield int(rows[i]), int(rows[j]), shared, united
            continue
        sizes = np.array([len(sets[r]) for r in rows])
        flat = np.concatenate([sets[r] for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes)
        tokens, where, times = np.unique(flat, return_inverse=True, return_counts=True)
        everywhere = times == len(rows)  # parts nothing
        needed = np.ceil(threshold * sizes - 1e-9) - everywhere.sum()
        # rows that need no other shared token are compared with each other; with the rest, they share what the rest needs
        stack.append((rows[needed <= 0], path, 0))
        if (needed <= 0).all():
            continue
        chosen = (_mix(tokens, path)[where] < 1 / np.maximum(needed, 1)[owner]) & ~everywhere[where]
        where, owner = where[chosen], owner[chosen]
        order = np.argsort(where, kind="stable")
        where, owner = where[order], owner[order]
        cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True]) if len(where) else np.array([0])
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e - s > 1:
                child = (path * 6364136223846793005 + int(tokens[where[s]]) * 2 + 1) & (1 << 64) - 1
                stack.append((rows[owner[s:e]], child, left - 1))


def _nodes(threshold: float, trees: int):
    """Batches sorted by node -> similar pairs; one node is held at a time. A large node of the root is split in so many trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, sets, root = None, [], [], False
        out: tuple[list, list, list, list] = ([], [], [], [])

        def close() -> None:
            if len(ids) < 2:
                return
            for tree in range(trees if root and len(ids) > BRUTE else 1):
                for i, j, shared, united in node_pairs(sets, current + tree * 0x9E3779B97F4A7C15, threshold):
                    a, b = (ids[i], ids[j]) if ids[i] < ids[j] else (ids[j], ids[i])
                    out[0].append(a), out[1].append(b), out[2].append(shared), out[3].append(united)

        def flush() -> pa.RecordBatch:
            # the same pair is found in many nodes; once a batch is enough
            rows = sorted(set(zip(*out)))
            for c in out:
                c.clear()
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["a", "b", "shared", "united"])

        for batch in batches:
            nodes, sids = batch.column("node").to_pylist(), batch.column("sid").to_pylist()
            roots = batch.column("root").to_pylist()
            tokens = batch.column("tokens")
            offsets, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
            for k, node in enumerate(nodes):
                if node != current:
                    close()
                    current, ids, sets, root = node, [], [], roots[k]
                ids.append(sids[k])
                sets.append(flat[offsets[k] : offsets[k + 1]])
            sets = [s.copy() for s in sets]  # not the whole batch
            if len(out[0]) > 50_000:
                yield flush()
        close()
        yield flush()

    return run


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        sids, blocks = table.column("sid").to_pylist(), table.column("block").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        order = np.argsort(blocks, kind="stable")
        lists = table.column("tokens").to_pylist()
        sets = [np.array(lists[i], dtype=np.int64) for i in order]
        split = None if low == high else int((blocks == low).sum())
        out = [(*sorted((sids[order[i]], sids[order[j]])), s, u) for i, j, s, u in brute_pairs(sets, split, threshold)]
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32())
        return pa.table({n: pa.array([r[i] for r in out], kind) for i, (n, kind) in enumerate(zip(("a", "b", "shared", "united"), kinds))})

    return run


def set_classes(members: DataFrame, key: str, member: str) -> tuple[DataFrame, DataFrame]:
    """(sid, tokens) of each distinct set, and (sid, key): which records hold it. ``member``: a member or a list of them."""
    rows = members.filter(F.col(key).isNotNull() & F.col(member).isNotNull())
    if isinstance(members.schema[member].dataType, ArrayType):
        tokens = F.transform(F.filter(member, lambda m: m.isNotNull()), lambda m: F.xxhash64(m))
        rows = rows.select(key, F.array_sort(F.array_distinct(tokens)).alias("tokens")).filter(F.size("tokens") > 0)
        rows = rows.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tokens")))).alias("tokens"))
    else:
        rows = rows.groupBy(key).agg(F.array_sort(F.collect_set(F.xxhash64(member))).alias("tokens"))
    rows = cut(rows.select(key, "tokens", F.unhex(F.md5(F.array_join(F.col("tokens").cast("array<string>"), ","))).alias("sid")))
    return rows.groupBy("sid").agg(F.first("tokens").alias("tokens")), rows.select("sid", key)


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if is_small(rows) else rows


def marked_classes(classes: DataFrame, threshold: float, rare: int = BRUTE) -> DataFrame:
    """sid, tokens, needed, lead, frequent: of each class the tokens that a similar set shares, at least; the rare tokens (those of
    at most ``rare`` classes) that make nodes; the others, by their number, where they alone can make it similar to another, else null."""
    counts = cut(classes.select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") > rare))
    marks = classes.select("sid", F.explode("tokens").alias("token")).join(_small(counts), "token")
    marks = marks.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("count", "token")))["token"].alias("frequent"))
    rows = classes.join(marks, "sid", "left").withColumn("frequent", F.coalesce("frequent", F.array().cast("array<bigint>")))
    rows = rows.withColumn("needed", F.ceil(F.size("tokens") * F.lit(threshold) - 1e-9).cast("int"))
    lead = F.slice(F.array_except("tokens", "frequent"), F.lit(1), F.greatest(F.size("tokens") - F.col("needed") + 1, F.lit(0)))
    return rows.select("sid", "tokens", "needed", lead.alias("lead"), F.when(F.size("frequent") >= F.col("needed"), F.col("frequent")).alias("frequent"))


def class_pairs(classes: DataFrame, threshold: float, recall: float = RECALL, node_rows: int = NODE_ROWS, levels: int = LEVELS, seed: int = 5, rare: int = BRUTE) -> DataFrame:
    """a < b (sid), shared, united: pairs of classes of Jaccard similarity ``threshold`` or more."""
    repeats = trees_for(recall, levels + DEPTH)
    marked = cut(marked_classes(classes, threshold, min(rare, BRUTE)))
    rows = marked.select("sid", "tokens", F.lit(True).alias("root"), F.explode("lead").alias("node"))
    first = F.slice("frequent", F.lit(1), F.size("frequent") - F.col("needed") + 1)
    nodes = marked.filter(F.col("frequent").isNotNull()).select("sid", "tokens", "needed", "frequent", F.posexplode(first).alias("at", "node"))
    # the pairs of a node share no token before it
    rest = F.slice("frequent", F.col("at") + 2, F.size("frequent"))
    nodes = nodes.select("sid", "tokens", F.lit(True).alias("root"), (F.col("needed") - 1).alias("needed"), rest.alias("rest"), "node")

    def split(rows: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64(F.col("token"), "node", F.lit(seed)), F.lit(_UNIT)) * F.col("needed") < _UNIT
        # sets that need no more shared tokens are one child, too
        rows = rows.withColumn("choice", F.when(F.col("needed") <= 0, F.concat("rest", F.array(F.lit(None).cast("bigint")))).otherwise(F.col("rest")))
        rows = rows.select("sid", "tokens", "needed", "rest", "node", F.explode("choice").alias("token")).filter(part)
        rest = F.filter("rest", lambda t: ~t.eqNullSafe(F.col("token")))
        return rows.select("sid", "tokens", F.lit(False).alias("root"), (F.col("needed") - 1).alias("needed"), rest.alias("rest"), F.xxhash64("node", "token", F.lit(seed)).alias("node"))

    for level in range(levels + 1):
        large = cut(nodes.groupBy("node").count().filter(F.col("count") > node_rows))
        if large.isEmpty():
            break
        large = _small(large)
        rows = rows.unionByName(nodes.join(large.select("node"), "node", "left_anti").select(rows.columns))
        if level < levels:
            nodes = nodes.join(large.select("node"), "node", "left_semi")
            if not level:
                trees = F.explode(F.sequence(F.lit(1), F.lit(repeats)))
                nodes = nodes.withColumn("tree", trees).withColumn("node", F.xxhash64("node", "tree", F.lit(seed))).drop("tree")
            nodes = split(nodes)
    tiles = None
    if large.isEmpty():
        rows = rows.unionByName(nodes.select(rows.columns))
    else:
        counted = nodes.join(large.withColumn("blocks", F.ceil(F.col("count") / node_rows)).select("node", "blocks"), "node")
        counted = counted.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        counted = counted.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
        counted = counted.select("node", "sid", "tokens", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        tiles = counted.groupBy("node", "low", "high").applyInArrow(_tile(threshold), _PAIRS)
    pairs = rows.repartition("node").sortWithinPartitions("node").mapInArrow(_nodes(threshold, trees_for(recall, DEPTH)), _PAIRS)
    return (pairs.unionByName(tiles) if tiles is not None else pairs).distinct()


def similar_set_pairs(members: DataFrame, key: str, member: str = "member", threshold: float = 0.6, **options: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a, b, similarity) and the membership (sid, key)."""
    classes, membership = set_classes(members, key, member)
    pairs = class_pairs(classes, threshold, **options)
    return pairs.select("a", "b", (F.col("shared") / F.col("united")).alias("similarity")), membership


def similar_records(members: DataFrame, key: str, member: str = "member", threshold: float = 0.6, **options: float) -> DataFrame:
    """``key``_a < ``key``_b, similarity: all pairs of records, copies expanded."""
    pairs, held = similar_set_pairs(members, key, member, threshold, **options)
    left, right = (held.select(F.col("sid").alias(side), F.col(key).alias(f"__{side}")) for side in "ab")
    across = pairs.join(left, "a").join(right, "b").select("__a", "__b", "similarity")
    within = left.join(right, F.col("a") == F.col("b")).filter(F.col("__a") < F.col("__b")).select("__a", "__b", F.lit(1.0).alias("similarity"))
    return across.unionByName(within).select(F.least("__a", "__b").alias(f"{key}_a"), F.greatest("__a", "__b").alias(f"{key}_b"), "similarity")


def record_classes(members: DataFrame, key: str, member: str = "member", threshold: float = 0.6, **options: float) -> DataFrame:
    """``key``, class_id (the least key of the records of the same set), copies, links: one row for each record, with the
    number of other classes its set is similar to."""
    pairs, held = similar_set_pairs(members, key, member, threshold, **options)
    links = pairs.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").count().withColumnRenamed("count", "links")
    classes = held.groupBy("sid").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("copies"))
    rows = held.join(classes.join(links, "sid", "left"), "sid")
    return rows.select(key, "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
