"""Answering queries: keyword and vector rankings, their fusion, graph expansion, grouping.

Queries are rows (qid, ...), so one plan answers one query or a whole evaluation
set. Query-side tables are small by nature; they are hinted for broadcast only
after a count has shown them so.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import index_terms, query_terms, snippet
from ..session import cut, is_small
from .index import KeywordIndex, stems

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Query vectors that every task may hold as one matrix, of any width, and numbers that those may have together if they are more.
MOST_HELD, NUMBERS_HELD = 2_000, 2_097_152
#: Query vectors multiplied with a batch at once, and pairs computed or passed on at once.
TILE, PAIRS = 256, 65_536
#: Queries up to which each pair of a query and a chunk is a row; more are scored block by block.
FEW_QUERIES = 16
#: Queries of which every task may hold the terms, and about as many chunks as one task scores them against.
TERMS_HELD, CHUNKS_HELD = 50_000, 65_536
#: Steps that one unit of a term's weight in a chunk is cut into, to tell what the best chunks have at least.
STEPS = 100
RRF_K, TOP_K, FUSE_TOP, MAX_CANDIDATES, LIMIT, WEAK = 60, 50, 20, 30, 15, 0.2


def small_side(df: DataFrame) -> DataFrame:
    """``df`` hinted for broadcast if a count shows it to be small, else as it is."""
    return F.broadcast(df) if is_small(df) else df


def filters(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that equal every value that is given."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def question_terms(queries: DataFrame, column: str = "q") -> DataFrame:
    """qid, term, weight: the index terms of each query; a repeated term weighs as often."""
    terms = F.flatten(F.transform(query_terms(F.col(column)), index_terms))
    return queries.select("qid", F.explode(terms).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("weight"))


def stemmed_terms(queries: DataFrame, column: str = "q") -> DataFrame:
    """As :func:`question_terms`, over stems, for an index of stems."""
    terms = question_terms(queries, column)
    return terms.join(stems(terms), "term").groupBy("qid", F.col("stem").alias("term")).agg(F.sum("weight").alias("weight"))


def bm25(index: KeywordIndex, queries: DataFrame, key: str = "chunk_id", column: str = "q", stemmed: bool = False) -> DataFrame:
    """qid, key, score of every chunk that holds a term of the query: for many queries use :func:`keyword_ranks`.

    The index's postings of the queries' terms are kept by a join that the query
    side's size decides; document frequencies are those the index keeps, else they
    come from those postings alone. ``stemmed``: for an index of stems.
    """
    terms = small_side(stemmed_terms(queries, column) if stemmed else question_terms(queries, column))
    hits = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = index.terms.join(terms.select("term").distinct(), "term", "left_semi") if index.terms is not None else hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = F.broadcast(index.stats)  # one row
    rows = hits.join(df, "term").join(terms, "term").crossJoin(stats)
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR))
    part = idf * term_share(F.col("mean")) * F.col("weight")
    return rows.groupBy("qid", key).agg(F.round(F.sum(part), 6).alias("score"))


def term_share(mean: Column) -> Column:
    """What a posting (tf, length) adds for each unit of its term's weight."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))


def keyword_ranks(
    index: KeywordIndex, queries: DataFrame, key: str = "chunk_id", column: str = "q", stemmed: bool = False, allowed: DataFrame | None = None, most: int = TOP_K,
    few: int = FEW_QUERIES, asked: int = TERMS_HELD, held: int = CHUNKS_HELD,
) -> DataFrame:
    """qid, key, score, rank of the ``most`` best chunks of each query by :func:`bm25`, exactly; with ``allowed`` (key)
    of those, while statistics are of the whole index.

    The pairs of a query and a chunk that share a term grow with both, so they are no
    rows. The postings of the queries' terms are dealt to blocks of about ``held``
    chunks. A task adds up the scores of one block for one query after another and
    passes on its best ``most``, of those only what reaches the score that ``most``
    chunks are known to have by one of the query's terms alone. The queries are cut
    into parts of about ``asked``.
    """
    terms = cut(stemmed_terms(queries, column) if stemmed else question_terms(queries, column))
    count = terms.select("qid").distinct().count()
    if count <= max(few, 0):
        scores = bm25(index, queries, key, column, stemmed)
        return ranked(scores if allowed is None else scores.join(allowed.select(key), key, "left_semi"), key, most)
    parts = -(-count // asked)
    every = [_best_by_terms(index, terms if parts == 1 else terms.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == b), key, allowed, most, held) for b in range(parts)]
    found = reduce(DataFrame.unionByName, [x for x in every if x is not None])
    return ranked(found.withColumn("score", F.round("score", 6)), key, most)


def _best_by_terms(index: KeywordIndex, terms: DataFrame, key: str, allowed: DataFrame | None, most: int, held: int) -> DataFrame | None:
    """qid, key, score of the best of each block of chunks for the queries of ``terms`` (qid, term, weight), which one task may hold."""
    spark = terms.sparkSession
    own = terms.toArrow().combine_chunks().sort_by("qid")
    if not own.num_rows:
        return None
    words = own.column("term").combine_chunks().dictionary_encode()
    ids = F.broadcast(spark.createDataFrame(pa.table({"term": words.dictionary, "__t": pa.array(range(len(words.dictionary)), pa.int32())})))
    n, mean = index.stats.select("n", "mean").first()
    blocks = max(1, -(-n // held), min(spark.sparkContext.defaultParallelism, -(-n // 4_096)))
    # a chunk's postings are one row with two lists, as rows of their own they take several times the disk
    hits = index.postings.join(ids, "term").groupBy(key, "length").agg(F.collect_list(F.struct("__t", F.col("tf").cast("int").alias("tf"))).alias("p"))
    hits = hits.select(key, F.col("length").cast("long").alias("length"), F.col("p.__t").alias("__t"), F.col("p.tf").alias("__tf"))
    hits = hits.withColumn("__in", F.lit(True)) if allowed is None else hits.join(allowed.select(key, F.lit(True).alias("__in")).distinct(), key, "left").withColumn("__in", F.coalesce("__in", F.lit(False)))
    hits = cut(hits.repartition(blocks, key))
    single = hits.select("__in", "length", F.explode(F.arrays_zip("__t", "__tf")).alias("p")).select("__in", "length", "p.__t", F.col("p.__tf").alias("tf"))
    single = single.withColumn("__g", term_share(F.lit(mean or 1.0)))

    # how many chunks hold each term, and what the ``most`` best of those allowed get by it at least
    steps = single.groupBy("__t", F.floor(F.col("__g") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("df"), F.count_if("__in").alias("n"))
    reached = F.sum("n").over(Window.partitionBy("__t").orderBy(F.desc("step")))
    known = steps.withColumn("reached", reached).groupBy("__t").agg(F.sum("df").alias("df"), F.max(F.when(F.col("reached") >= most, F.col("step"))).alias("step"))
    if index.terms is not None:
        known = known.drop("df").join(index.terms.join(ids, "term").select("__t", "df"), "__t")
    known = known.select("__t", "df", F.coalesce("step", F.lit(0)).alias("step")).toArrow()
    at = known.column("__t").to_numpy()
    idf, least = np.zeros(len(words.dictionary)), np.zeros(len(words.dictionary))
    idf[at] = [max(math.log((n - d + 0.5) / (d + 0.5)), FLOOR) for d in known.column("df").to_pylist()]
    least[at] = known.column("step").to_numpy() / STEPS

    of = words.indices.to_numpy()
    weight = own.column("weight").to_numpy() * idf[of]
    qids = own.column("qid").combine_chunks()
    first = np.flatnonzero(np.r_[True, pc.not_equal(qids[1:], qids[:-1]).to_numpy(zero_copy_only=False)])
    floor = np.maximum.reduceat(weight * least[of], first) * (1 - 1e-9) - 2e-6  # scores are compared as rounded
    kinds = [terms.schema["qid"].dataType, index.postings.schema[key].dataType]
    shared = spark.sparkContext.broadcast((qids.take(pa.array(first)), np.r_[first, len(of)], of, weight, floor, len(idf), mean or 1.0))
    return hits.filter("__in").select("__t", key, "__tf", "length").mapInArrow(_best_of_block(shared, most, [to_arrow_type(k) for k in kinds], key), f"qid {kinds[0].simpleString()}, `{key}` {kinds[1].simpleString()}, score double")


def _best_of_block(shared, most: int, types: list[pa.DataType], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of a block (terms' numbers, key, how often each occurs, length) -> qid, key, score of each query's best of them."""
        qids, first, of, weight, floor, size, mean = shared.value
        rows = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        coded = rows.column(1).combine_chunks().dictionary_encode(null_encoding="encode")
        order = pc.array_sort_indices(coded.dictionary, null_placement="at_start")
        keys, place = coded.dictionary.take(order), np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        terms, tf = (rows.column(i).combine_chunks() for i in (0, 2))
        each = np.diff(terms.offsets.to_numpy())
        chunk, term, tf, length = np.repeat(place[coded.indices.to_numpy()], each), terms.flatten().to_numpy(), tf.flatten().to_numpy(), np.repeat(rows.column(3).to_numpy(), each)
        share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        order = np.lexsort((chunk, term))
        chunk, term, share = chunk[order], term[order], share[order]
        new = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(chunk) != 0)])
        if len(new) < len(term):  # a key that the index holds twice
            chunk, term, share = chunk[new], term[new], np.add.reduceat(share, new)
        ends = np.searchsorted(term, np.arange(size + 1))
        total = np.zeros(len(keys))
        out: tuple[list, list, list] = ([], [], [])
        held = 0

        def batch() -> pa.RecordBatch:
            own = qids.take(pa.array(np.repeat([q for q, _ in out[0]], [k for _, k in out[0]])))
            columns = [own.cast(types[0]), keys.take(pa.array(np.concatenate(out[1]))).cast(types[1]), pa.array(np.concatenate(out[2]))]
            for x in out:
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["qid", key, "score"])

        for q in range(len(qids)):
            spans = [(ends[of[i]], ends[of[i] + 1], weight[i]) for i in range(first[q], first[q + 1])]
            touched = sum(b - a for a, b, _ in spans)
            if not touched:
                continue
            for a, b, w in spans:
                total[chunk[a:b]] += w * share[a:b]
            if touched * 8 < len(total):
                near = np.concatenate([chunk[a:b] for a, b, _ in spans])
                found = np.unique(near[total[near] >= floor[q]])
                scores = total[found]
                total[near] = 0
            else:
                found = np.flatnonzero(total >= max(floor[q], 1e-300))
                scores = total[found]
                total.fill(0)
            if len(found) > most:
                rounded = np.round(scores, 6)
                top = np.flatnonzero(rounded >= np.partition(rounded, -most)[-most])
                top = top[np.lexsort((found[top], -rounded[top]))[:most]]  # equal scores by key
                found, scores = found[top], scores[top]
            if len(found):
                out[0].append((q, len(found))), out[1].append(found), out[2].append(scores)
                held += len(found)
            if held > 50_000:
                held = 0
                yield batch()
        if held:
            yield batch()

    return run


def ranked(scores: DataFrame, key: str, most: int = TOP_K, rank: str = "rank") -> DataFrame:
    """The ``most`` best of each query with their rank from 1; equal scores by key."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return scores.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= most)


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "chunk_id", vector: str = "vector", most: int = TOP_K, held: int | None = None, model: str | None = None) -> DataFrame:
    """qid, key, score, rank: the most similar vectors to each query's (qid, qvec), exactly; filter ``vectors`` before.

    The queries are cut into blocks of about ``held``, by default as many as make up
    about ``NUMBERS_HELD``. A block is held as one matrix by every task. There are as
    many tasks as cores, and each passes on its best ``most`` of each query once, so
    rows do not grow with the vectors. Vectors of another width, null, zero or with
    NaN match nothing; with ``model``, a column of both sides, so do those of another
    model.
    """
    columns = ["qid", F.col("qvec").cast("array<double>").alias("qvec")] + ([model] if model else [])
    asked = queries.select(*columns).filter(F.size("qvec") > 0)
    count, width = asked.agg(F.count(F.lit(1)), F.max(F.size("qvec"))).first()
    held = held or max(MOST_HELD, NUMBERS_HELD // max(1, width or 1))
    number = _number(vectors.schema[vector].dataType)
    sides = [key, F.col(vector).cast(f"array<{number}>").alias("__v")] + ([model] if model else [])
    sides = vectors.select(*sides).filter(F.col("__v").isNotNull()).coalesce(max(1, vectors.sparkSession.sparkContext.defaultParallelism))
    if count > held:
        blocks = -(-count // held)
        part = F.pmod(F.xxhash64("qid"), F.lit(blocks))
        asked = cut(asked.withColumn("__part", part))
        every = [_nearest_block(sides, asked.filter(F.col("__part") == b).drop("__part"), key, most, model) for b in range(blocks)]
    else:
        every = [_nearest_block(sides, asked, key, most, model)]
    return ranked(reduce(DataFrame.unionByName, every), key, most)


def _number(kind) -> str:
    """The kind of number that the vectors of a column are read as."""
    return "float" if kind.elementType.simpleString() == "float" else "double"


def _nearest_block(vectors: DataFrame, queries: DataFrame, key: str, most: int, model: str | None) -> DataFrame:
    """qid, key, score of the best of each partition of ``vectors`` (key, __v) for the ``queries``, which one task may hold."""
    kinds = [queries.schema["qid"].dataType, vectors.schema[key].dataType]
    rows = queries.toArrow().combine_chunks()
    lists = rows.column("qvec").combine_chunks()
    names = np.array(rows.column(model).to_pylist() if model else [None] * len(lists), dtype=object)
    widths = np.diff(lists.offsets.to_numpy())
    sides = {}
    for name, width in sorted(set(zip(names.tolist(), widths.tolist())), key=str):
        own = pa.array(np.flatnonzero((names == name) & (widths == width)))
        m = lists.take(own).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), width)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            sides[name, width] = (rows.column("qid").combine_chunks().take(own), m / np.linalg.norm(m, axis=1)[:, None])
    shared = vectors.sparkSession.sparkContext.broadcast(sides)
    types = [to_arrow_type(k) for k in kinds]
    return vectors.mapInArrow(_nearest_of_part(shared, most, types, key, bool(model)), f"qid {kinds[0].simpleString()}, `{key}` {kinds[1].simpleString()}, score double")


class _Nearest:
    """The ``most`` best keys of each of some queries (unit rows of ``m``) among the vectors added so far.

    Cosines are taken as float32 first. ``low`` is what a pair has at least as such
    to be among the best: the worst of the best so far, less what float32 and rounding
    may be off. What reaches it is computed again in double."""

    def __init__(self, m: np.ndarray, most: int, kind: pa.DataType):
        self.m, self.most = m, most
        self.short = m.astype(np.float32)
        self.off = (m.shape[1] + 8) * 1.2e-7 + 2e-6
        self.low = np.full(len(m), -2, np.float32)
        self.q, self.score, self.keys = np.zeros(0, np.int32), np.zeros(0), pa.array([], kind)
        self.new: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.held = 0

    def add(self, keys: pa.Array, x: np.ndarray) -> None:
        """``x``: unit vectors, side by side with their keys."""
        short = np.ascontiguousarray(x.astype(np.float32).T)
        for start in range(0, len(self.m), TILE):
            near = self.short[start : start + TILE] @ short
            low = self.low[start : start + TILE]
            at = np.flatnonzero(near >= low[:, None])
            if len(at) > 4 * self.most * len(near) and near.shape[1] > self.most:
                near[np.isnan(near)] = -9
                np.maximum(low, np.partition(near, -self.most, axis=1)[:, -self.most] - np.float32(self.off), out=low)
                at = np.flatnonzero(near >= low[:, None])
            if not len(at):
                continue
            q, k = np.divmod(at, near.shape[1])
            q += start
            score = np.concatenate([np.einsum("ij,ij->i", self.m[q[i : i + PAIRS]], x[k[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)])
            score = np.round(score, 6)
            names = keys.take(pa.array(k))
            if len(q) > 4 * self.most * len(near):  # many are equally near
                q, score, names = _best_of_each(q, score, names, self.most)
            self.new.append((q.astype(np.int32), score, names))
            self.held += len(q)
            if self.held > max(PAIRS, self.most * len(self.m)):
                self.fold()
        if len(self.q) == 0:
            self.fold()

    def fold(self) -> None:
        if not self.new:
            return
        q, score = (np.concatenate([own, *(x[i] for x in self.new)]) for i, own in enumerate((self.q, self.score)))
        names = pa.concat_arrays([self.keys, *(x[2] for x in self.new)])
        self.new, self.held = [], 0
        self.q, self.score, self.keys = _best_of_each(q, score, names, self.most)
        first = np.searchsorted(self.q, np.arange(len(self.m) + 1))
        full = np.flatnonzero(np.diff(first) == self.most)
        self.low[full] = np.maximum(self.low[full], self.score[first[full + 1] - 1] - self.off)


def _best_of_each(q: np.ndarray, score: np.ndarray, keys: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ``most`` rows of the highest score of each query, equal scores by key; by query and falling score."""
    order = np.lexsort((-score, q))
    q, score = q[order], score[order]
    first = np.flatnonzero(np.r_[True, np.diff(q) > 0]) if len(q) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(q)])
    worst = np.repeat(np.where(size > most, score[np.minimum(first + most, len(q)) - 1], -np.inf), size)
    place = np.arange(len(q)) - np.repeat(first, size)
    keep = score > worst
    tied = np.flatnonzero(score == worst)
    if len(tied):  # of those as good as the last place, the first keys
        by = pa.table({"q": q[tied], "k": keys.take(pa.array(order[tied]))})
        tied_order = pc.sort_indices(by, sort_keys=[("q", "ascending"), ("k", "ascending")], null_placement="at_start").to_numpy()
        at = np.flatnonzero(np.r_[True, np.diff(q[tied]) > 0])
        count = np.diff(np.r_[at, len(tied)])
        left = most - np.repeat(place[tied][at], count)
        keep[tied[tied_order[np.arange(len(tied)) - np.repeat(at, count) < left]]] = True
    return q[keep], score[keep], keys.take(pa.array(order[keep]))


def _nearest_of_part(shared, most: int, types: list[pa.DataType], key: str, model: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {side: (qids, _Nearest(m, most, types[1])) for side, (qids, m) in shared.value.items()}
        for batch in batches:
            lists = batch.column(1)
            widths = np.diff(lists.offsets.to_numpy())
            models = np.array(batch.column(2).to_pylist(), dtype=object) if model else None
            for (name, width), (_, held) in best.items():
                take = pa.array(np.flatnonzero((widths == width) & (models == name) if model else widths == width))
                if not len(take):
                    continue
                x = lists.take(take).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(take), width)
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    held.add(batch.column(0).take(take), x / np.linalg.norm(x, axis=1)[:, None])
        for qids, held in best.values():
            held.fold()
            for i in range(0, len(held.q), PAIRS):
                end = i + PAIRS
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(held.q[i:end])).cast(types[0]), held.keys[i:end].cast(types[1]), pa.array(held.score[i:end])], ["qid", key, "score"])

    return run


def reciprocal_rank_fusion(rankings: list[DataFrame], key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """qid, key, rrf: the sum of 1 / (k + rank) over the rankings (qid, key, rank)."""
    rows = rankings[0].select("qid", key, "rank")
    for more in rankings[1:]:
        rows = rows.unionByName(more.select("qid", key, "rank"))
    return rows.groupBy("qid", key).agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 6).alias("rrf"))


def fuse(vector_ranks: DataFrame, keyword_ranks: DataFrame, key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """qid, key, vector_rank, bm25_rank, rrf of everything in either ranking."""
    both = vector_ranks.select("qid", key, F.col("rank").alias("vector_rank"), F.lit(None).cast("int").alias("bm25_rank"))
    both = both.unionByName(keyword_ranks.select("qid", key, F.lit(None).cast("int").alias("vector_rank"), F.col("rank").alias("bm25_rank")))
    rows = both.groupBy("qid", key).agg(F.min("vector_rank").alias("vector_rank"), F.min("bm25_rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    return rows.withColumn("rrf", F.round(part("vector_rank") + part("bm25_rank"), 6))


def cut_candidates(fused: DataFrame, key: str = "chunk_id", most: int = MAX_CANDIDATES, by: str = "rrf") -> DataFrame:
    """The ``most`` best fused rows of each query; ties by origin, vector rank, keyword rank and key."""
    graph = [F.col("from_graph")] if "from_graph" in fused.columns else []
    order = Window.partitionBy("qid").orderBy(F.desc(by), *graph, F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"), key)
    return fused.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def first_chunks(chunks: DataFrame, concepts: DataFrame, most: int = 2) -> DataFrame:
    """The first ``most`` chunks of each of ``concepts`` (qid, concept_id)."""
    order = Window.partitionBy("concept_id").orderBy("chunk_index", "chunk_id")
    top = chunks.join(concepts.select("concept_id").distinct(), "concept_id", "left_semi").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")
    return concepts.select("qid", "concept_id").distinct().join(top, "concept_id")


def expand(fused: DataFrame, chunks: DataFrame, edges: DataFrame, top: int = FUSE_TOP, per_concept: int = 2, hops: int = 1) -> DataFrame:
    """``fused`` with the first chunks of the concepts linked to those of its ``top`` rows; they have rrf 0 and come from the graph."""
    from .graph import neighbours

    owner = chunks.select("chunk_id", "concept_id")
    seeds = cut_candidates(fused, most=top).join(owner, "chunk_id").select("qid", "concept_id").distinct()
    near = neighbours(edges, seeds, hops)
    added = first_chunks(chunks, near, per_concept).select("qid", "chunk_id").join(fused.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    added = added.select("qid", "chunk_id", F.lit(None).cast("int").alias("vector_rank"), F.lit(None).cast("int").alias("bm25_rank"), F.lit(0.0).alias("rrf"), F.lit(True).alias("from_graph"))
    return fused.withColumn("from_graph", F.lit(False)).unionByName(added)


def lexical_overlap(query: str, document: str) -> float:
    """The default reranker: the share of the query's distinct words that the document holds."""
    words = set(query.lower().split())
    return len(words & set(document.lower().split())) / len(words) if words else 0.0


def rerank(hits: DataFrame, score: Callable[[str, str], float] = lexical_overlap, chars: int = 700) -> DataFrame:
    """``hits`` (with q and text) with the column rerank; a pair that cannot be scored gets 0."""

    @F.pandas_udf("double")
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> float:
            try:
                return float(score(a or "", (b or "")[:chars]))
            except Exception:
                return 0.0

        return pd.Series([one(a, b) for a, b in zip(q, t)])

    return hits.withColumn("rerank", scored("q", "text"))


def final_score(rerank_score: Column, rrf: Column) -> Column:
    """The reranker's score unless it is 0, else the fused one."""
    return F.when(F.coalesce(rerank_score, F.lit(0.0)) != 0, rerank_score).otherwise(rrf)


def search(
    chunks: DataFrame, index: KeywordIndex, queries: DataFrame, vectors: DataFrame | None = None, edges: DataFrame | None = None, reranker: Callable[[str, str], float] | None = None, limit: int = LIMIT, hops: int = 1,
    sensitivity: str | None = None, source: str | None = None, concept_type: str | None = None, strict_filters: bool = False, model: str | None = None,
) -> DataFrame:
    """The whole pipeline for queries (qid, q and, with ``vectors``, qvec): one row for each of the ``limit`` best hits.

    Filters restrict the vectors before they are ranked and the keyword hits after
    scoring (statistics are of the whole index). Chunks added by the graph are only
    filtered with ``strict_filters``. Without vectors the keyword ranking alone
    answers. A limit of 0 means the default. ``model``: the column of both sides that
    names the vectors' model.
    """
    wanted = {"sensitivity": sensitivity, "source": source, "concept_type": concept_type}
    words, near = rankings(chunks, index, queries, vectors, model=model, **wanted)
    return answers(chunks, queries, near, words, edges, reranker, limit, hops, filters(chunks, **wanted) if strict_filters else None)


def rankings(chunks: DataFrame, index: KeywordIndex, queries: DataFrame, vectors: DataFrame | None = None, model: str | None = None, **wanted: str | None) -> tuple[DataFrame, DataFrame | None]:
    """The keyword and the vector ranking (None without vectors) of the chunks that have the ``wanted`` values."""
    allowed = filters(chunks, **wanted).select("chunk_id")
    words = keyword_ranks(index, queries, allowed=allowed)
    return words, None if vectors is None else nearest(vectors.join(allowed, "chunk_id", "left_semi"), queries, model=model)


def answers(chunks: DataFrame, queries: DataFrame, near: DataFrame | None, words: DataFrame, edges: DataFrame | None = None, reranker: Callable[[str, str], float] | None = None, limit: int = LIMIT, hops: int = 1, linked: DataFrame | None = None) -> DataFrame:
    """The hits of :func:`search` by the two rankings; the graph adds chunks of ``linked``, which are all unless given."""
    fused = fuse(words.select("qid", "chunk_id", "rank").limit(0) if near is None else near, words)
    rows = expand(fused, chunks if linked is None else linked, edges, hops=hops) if edges is not None and hops else fused.withColumn("from_graph", F.lit(False))
    top = cut_candidates(rows).drop("place")
    hits = top.join(chunks, "chunk_id").join(small_side(queries.select("qid", "q")), "qid")
    hits = rerank(hits, reranker) if reranker else hits.withColumn("rerank", F.lit(0.0))
    hits = hits.withColumn("score", F.round(final_score(F.col("rerank"), F.col("rrf")), 6))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= (limit or LIMIT))


def group_hits(hits: DataFrame) -> DataFrame:
    """qid, concept_id, score, passages, headings, preview: hits by document, headings in the order of rank."""
    place = F.struct("place", "heading_path")
    rows = hits.groupBy("qid", "concept_id").agg(
        F.max("score").alias("score"), F.count(F.lit(1)).alias("passages"), F.min("place").alias("place"),
        F.array_sort(F.collect_list(place)).alias("__headings"), F.min_by("text", "place").alias("__text"), F.min_by("title", "place").alias("title"),
    )
    headings = F.array_distinct(F.filter(F.transform("__headings", lambda x: x["heading_path"]), lambda h: F.coalesce(h, F.lit("")) != ""))
    return rows.select("qid", "concept_id", "title", "score", "passages", "place", headings.alias("headings"), snippet(F.col("__text")).alias("preview"))


def is_weak(grouped: DataFrame, degraded: bool = False, weak: float = WEAK) -> DataFrame:
    """qid, weak: whether there are results, none of them good, and nothing was left out by a failure."""
    return grouped.groupBy("qid").agg((F.max("score") < weak).alias("weak")).withColumn("weak", F.col("weak") & F.lit(not degraded))


def found_by(vector_rank: Column, bm25_rank: Column, from_graph: Column) -> Column:
    """Where a hit comes from, as labels."""
    return F.array_compact(
        F.array(
            F.when(vector_rank.isNotNull(), F.concat(F.lit("vector#"), vector_rank.cast("string"))), F.when(bm25_rank.isNotNull(), F.concat(F.lit("bm25#"), bm25_rank.cast("string"))), F.when(from_graph, F.lit("graph"))
        )
    )
