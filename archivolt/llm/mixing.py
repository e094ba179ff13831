"""Mixing sources to target weights.

For each mix, the tokens of every source are added up; the mix's nominal size is
the number of tokens of all the sources it names. A source is repeated ``rate =
target_share * size / tokens`` times, at most ``max_repeats``: each document is
emitted floor(rate) times, plus once more with a probability equal to the
fraction, decided by a hash of mix, document and seed. A source too small for its
share is repeated ``max_repeats`` times and reported as capped; the others keep
their part of the nominal size, so that their reached shares are above the targets.
With ``exact`` the size is reduced to what the scarcest source that has documents
allows, so that none is capped and all targets are reached.

Documents without tokens (null or empty text) and documents of a null source or
of a source that the mix does not name are in no selection. A source without
documents reaches the share 0. Repeated (mix, source) targets are added up, with
the largest max_repeats; null shares or repeats count as 0. Shares need not sum
to 1. Empty tables give no selection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, is_small
from .byte_pair import TOKENIZERS, VOCABULARY, count_tokens


def token_sizes(documents: DataFrame, tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of every document with a source and tokens; materialised, as all mixes read it."""
    rows = documents.select("doc_id", "source", "text").filter(F.col("source").isNotNull() & (F.col("text") != ""))
    return cut(count_tokens(rows, "text", tokenizers, name))


def mix_rates(sizes: DataFrame, targets: DataFrame, exact: bool = False) -> DataFrame:
    """mix, source, target_share, max_repeats, source_docs, source_tokens, rate, capped: one row for each target."""
    wanted = (
        targets.filter(F.col("mix").isNotNull() & F.col("source").isNotNull())
        .groupBy("mix", "source")
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).cast("int").alias("max_repeats"))
    )
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("source_docs"), F.sum("n_tokens").alias("source_tokens"))
    rows = wanted.join(totals, "source", "left").na.fill(0, ["source_docs", "source_tokens"])
    scarce = F.when((F.col("target_share") > 0) & (F.col("source_tokens") > 0), F.col("max_repeats") * F.col("source_tokens") / F.col("target_share"))
    size = F.least(F.sum("source_tokens"), F.floor(F.min(scarce)).cast("long")) if exact else F.sum("source_tokens")
    size = rows.groupBy("mix").agg(size.alias("mix_tokens"))
    ideal = F.when(F.col("source_tokens") > 0, F.col("target_share") * F.col("mix_tokens") / F.col("source_tokens")).otherwise(0.0)
    rows = rows.join(size, "mix").withColumn("ideal", ideal)
    return rows.select(
        "mix", "source", "target_share", "max_repeats", "source_docs", "source_tokens", "mix_tokens",
        F.greatest(F.lit(0.0), F.least("ideal", F.col("max_repeats").cast("double"))).alias("rate"),
        (F.col("ideal") > F.col("max_repeats")).alias("capped"),
    )


def mixed_copies(sizes: DataFrame, rates: DataFrame, seed: int = 7) -> DataFrame:
    """mix, source, doc_id, n_tokens, copies of every selected document."""
    named = rates.filter(F.col("rate") > 0).select("mix", "source", "rate")
    if is_small(named):  # a configuration: one row for each target
        named = F.broadcast(named)
    draw = F.pmod(F.xxhash64("mix", "doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    whole = F.floor("rate")
    copies = (whole + (draw < F.col("rate") - whole).cast("int")).cast("int")
    rows = sizes.filter(F.col("n_tokens") > 0).join(named, "source").withColumn("copies", copies)
    return rows.filter(F.col("copies") > 0).select("mix", "source", "doc_id", "n_tokens", "copies")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, tokenizers: str = TOKENIZERS, name: str = VOCABULARY, exact: bool = False) -> DataFrame:
    """mix, source, doc_id, copy (from 1), n_tokens: one row for each use of a document."""
    sizes = token_sizes(documents, tokenizers, name)
    rows = mixed_copies(sizes, cut(mix_rates(sizes, targets, exact)), seed)
    return rows.select("mix", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "n_tokens")


def mix_shares(documents: DataFrame, targets: DataFrame, seed: int = 7, tokenizers: str = TOKENIZERS, name: str = VOCABULARY, exact: bool = False) -> DataFrame:
    """The shares reached: :func:`mix_rates` with used_docs, used_tokens and reached_share."""
    sizes = token_sizes(documents, tokenizers, name)
    rates = cut(mix_rates(sizes, targets, exact))
    used = mixed_copies(sizes, rates, seed).groupBy("mix", "source").agg(F.count(F.lit(1)).alias("used_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    rows = rates.join(used, ["mix", "source"], "left").na.fill(0, ["used_docs", "used_tokens"])
    total = rows.groupBy("mix").agg(F.sum("used_tokens").alias("__all"))
    return rows.join(total, "mix").withColumn("reached_share", F.when(F.col("__all") > 0, F.col("used_tokens") / F.col("__all")).otherwise(0.0)).drop("__all")
