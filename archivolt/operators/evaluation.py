"""Measuring retrieval: ranks of expected concepts, hit rates, probes from held-out sentences."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, word_count
from ..session import cut


def concept_ranks(hits: DataFrame) -> DataFrame:
    """qid, concept_id, rank: concepts numbered in the order of their best passage (hits: qid, concept_id, place)."""
    best = hits.groupBy("qid", "concept_id").agg(F.min("place").alias("place"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("place", "concept_id"))).select("qid", "concept_id", "rank")


def question_results(questions: DataFrame, ranks: DataFrame, best: DataFrame) -> DataFrame:
    """qid, answerable, rank (of the first expected concept), best_score. ``questions`` has qid, concepts; ``best`` qid, best_score."""
    found = questions.select("qid", F.explode("concepts").alias("concept_id")).join(ranks, ["qid", "concept_id"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    return questions.select("qid", (F.size("concepts") > 0).alias("answerable")).join(found, "qid", "left").join(best, "qid", "left")


def metrics(results: DataFrame, weak: float = 0.2) -> DataFrame:
    """Hit rates at 1, 3, 5 and 10, mean reciprocal rank, and the shares of abstentions and of confident answers; one row."""
    ok = F.col("answerable")
    rate = lambda test, of: F.round(F.avg(F.when(of, F.coalesce(test, F.lit(False)).cast("double"))), 6)
    score = F.coalesce("best_score", F.lit(0.0))
    return results.agg(
        *[rate(F.col("rank") <= k, ok).alias(f"hit_{k}") for k in (1, 3, 5, 10)],
        F.round(F.avg(F.when(ok, F.coalesce(1 / F.col("rank"), F.lit(0.0)))), 6).alias("mrr"),
        rate(score < weak, ~ok).alias("abstention"),
        rate(score >= weak, ok).alias("confidence"),
    )


def latencies(times: DataFrame) -> DataFrame:
    """median, mean, min, max and p90 of ms; p90 is the value at place int(0.9 n) of the sorted values."""
    times = times.select("ms").filter("ms IS NOT NULL")
    n = times.count()
    place = max(1, int(n * 0.9))
    # percentile_disc counts distinct values: it takes the first that stands at or after the place
    share = (place - 0.5) / n if n else 0.9
    return times.agg(F.median("ms").alias("median"), F.avg("ms").alias("mean"), F.min("ms").alias("least"), F.max("ms").alias("most"), F.expr(f"percentile_disc({share!r}) WITHIN GROUP (ORDER BY ms)").alias("p90"))


def held_out_sentence(texts: DataFrame, least: int = 8, most: int = 40) -> DataFrame:
    """chunk_id, sentence: the longest sentence of ``least`` to ``most`` words, the first of several."""
    rows = texts.select("chunk_id", F.posexplode(sentences(F.col("text"))).alias("n", "sentence")).withColumn("words", word_count(F.col("sentence")))
    rows = rows.filter(F.col("words").between(least, most))
    return rows.groupBy("chunk_id").agg(F.max_by("sentence", F.struct("words", -F.col("n"))).alias("sentence"))


def build_probes(chunks: DataFrame, count: int, remaining: int = 25) -> DataFrame:
    """chunk_id, query, text: a sentence of a chunk as the query, and the chunk without it; ``count`` of them chosen by hash."""
    picked = held_out_sentence(chunks).join(chunks.select("chunk_id", "text"), "chunk_id")
    rows = picked.select("chunk_id", F.col("sentence").alias("query"), F.trim(F.replace("text", "sentence", F.lit(""))).alias("text"))
    return rows.filter(word_count(F.col("text")) >= remaining).orderBy(F.md5(F.concat("chunk_id", F.lit("11"))), "chunk_id").limit(count)


def probe_ranks(scores: DataFrame) -> DataFrame:
    """qid, rank of each probe's target: one more than the number of better scores (scores: qid, key, target, score)."""
    own = scores.filter(F.col("key") == F.col("target")).select("qid", F.col("score").alias("own"))
    return scores.join(own, "qid").groupBy("qid").agg((F.sum((F.col("score") > F.col("own")).cast("long")) + 1).alias("rank"))


def target_ranks(vectors: DataFrame, probes: DataFrame, key: str, vector: str, held: int = 2_000) -> DataFrame:
    """qid, rank of each probe's target among all vectors but the probe's own: one more than the number of better ones.
    ``probes`` has qid (a value of ``key``), qvec and target. The probes are compared in blocks of about ``held``: each
    task multiplies its vectors with a block and counts, so that no pair leaves it."""
    own = probes.join(vectors.select(F.col(key).alias("target"), F.col(vector).alias("__t")), "target")
    count = own.count()
    blocks = max(1, -(-count // held))
    own = cut(own.select("qid", F.col("qvec").cast("array<double>").alias("q"), F.col("__t").cast("array<double>").alias("t"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block")))
    kind = own.schema["qid"].dataType.simpleString()
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    parts = []
    for b in range(blocks):
        rows = own.filter(F.col("block") == b).collect()  # about ``held``
        if not rows:
            continue
        qids, q, t = [r["qid"] for r in rows], unit(np.array([r["q"] for r in rows])), unit(np.array([r["t"] for r in rows]))
        goal = np.round((q * t).sum(axis=1), 6)

        def better(batches, qids=qids, q=q, goal=goal):
            for batch in batches:
                x = unit(np.array(batch.iloc[:, 1].tolist(), dtype=np.float64).reshape(len(batch), -1)) if len(batch) else np.zeros((0, q.shape[1]))
                over = (np.round(q @ x.T, 6) > goal[:, None]) & (np.array(qids, dtype=object)[:, None] != batch.iloc[:, 0].to_numpy(dtype=object)[None, :])
                yield pd.DataFrame({"qid": qids, "n": over.sum(axis=1)})

        parts.append(vectors.select(key, F.col(vector).cast("array<double>")).mapInPandas(better, f"qid {kind}, n long"))
    if not parts:
        return probes.select("qid", F.lit(0).cast("long").alias("rank")).limit(0)
    return reduce(DataFrame.unionByName, parts).groupBy("qid").agg((F.sum("n") + 1).alias("rank"))


def benchmark(chunks: DataFrame, embedders: dict[str, Callable[[pd.Series], pd.Series]], probes: int = 150, least: int = 50) -> DataFrame:
    """embedder, recall_1, recall_5, recall_10, mrr, seconds of each embedder (texts -> vectors), all on the same chunks
    (chunk_id, text) and the same probes. Fewer chunks than ``least`` are an error."""
    if chunks.limit(least).count() < least:
        raise ValueError(f"a benchmark needs {least} chunks")
    asked = cut(build_probes(chunks, probes))
    rest = chunks.join(asked.select("chunk_id", F.col("text").alias("__rest")), "chunk_id", "left").select("chunk_id", F.coalesce("__rest", "text").alias("text"))
    parts = []
    for name, embed in embedders.items():
        began = time.monotonic()
        vector = F.pandas_udf(embed, "array<double>")
        vectors = cut(rest.select("chunk_id", vector("text").alias("vector")))
        # a probe is a vector of its own that no other probe is compared with
        queries = asked.select(F.concat(F.lit("?"), "chunk_id").alias("qid"), vector("query").alias("qvec"), F.col("chunk_id").alias("target"))
        row = recall(target_ranks(vectors, queries, "chunk_id", "vector"))
        parts.append(cut(row.select(F.lit(name).alias("embedder"), "*", F.lit(time.monotonic() - began).alias("seconds"))))
    return reduce(DataFrame.unionByName, parts)


def benchmark_report(results: DataFrame) -> DataFrame:
    """best, fastest: the embedder of the best recall at 5 (of several the one of the best mrr) and the fastest; one row."""
    return results.agg(F.max_by("embedder", F.struct("recall_5", "mrr")).alias("best"), F.min_by("embedder", "seconds").alias("fastest"))


def collect_chunks(chunks: DataFrame, count: int, words: tuple[int, int] = (200, 20_000), least: int = 40, seed: str = "11") -> DataFrame:
    """chunk_id, text: ``count`` chunks of ``least`` words or more, of documents whose word count lies in ``words``, in hash order."""
    sized = chunks.select("chunk_id", "concept_id", "text", word_count(F.col("text")).alias("n"))
    whole = sized.groupBy("concept_id").agg(F.sum("n").alias("total")).filter(F.col("total").between(*words))
    rows = sized.filter(F.col("n") >= least).join(whole, "concept_id", "left_semi")
    return rows.orderBy(F.md5(F.concat("chunk_id", F.lit(seed))), "chunk_id").limit(count).select("chunk_id", "text")


def sampled_by_type(records: DataFrame, count: int, kind: str = "concept_type", order: str = "concept_id") -> DataFrame:
    """The records of a round-robin over the types, of each the middle one of those left, ``count`` in all; with place.

    Taking the middle element of a sorted list again and again visits the places next to the middle in turn, the left
    one first where two are left: the visit of a place is told by its distance from the middle.
    """
    place = F.row_number().over(Window.partitionBy(kind).orderBy(order)) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy(kind))
    rows = records.withColumn("__at", place).withColumn("__mid", F.floor(size / 2))
    left = F.col("__at") < F.col("__mid")
    even = F.pmod(size, F.lit(2)) == 0
    # an even list is left with its middle on the left side, an odd one on the right
    visit = F.when(F.col("__at") == F.col("__mid"), 0).when(left, F.when(even, 2 * (F.col("__mid") - F.col("__at")) - 1).otherwise(2 * (F.col("__mid") - F.col("__at")))).otherwise(F.when(even, 2 * (F.col("__at") - F.col("__mid"))).otherwise(2 * (F.col("__at") - F.col("__mid")) - 1))
    rows = rows.withColumn("turn", visit)
    return rows.orderBy("turn", kind).limit(count).drop("__at", "__mid")


def recall(ranks: DataFrame) -> DataFrame:
    """recall at 1, 5 and 10, and mean reciprocal rank; one row."""
    return ranks.agg(*[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"recall_{k}") for k in (1, 5, 10)], F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"))
