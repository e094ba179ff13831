"""The keyword index as tables: postings, document lengths and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_terms
from ..session import cut, is_small

#: Different terms up to which the table of their stems is sent to the postings, so that those need not travel.
STEMS_SENT = 1_000_000


@dataclass
class KeywordIndex:
    """postings (term, chunk_id, tf, length of the chunk), lengths (chunk_id, length), stats (one row: n, mean) and,
    where they are kept, terms (term, df)."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    terms: DataFrame | None = None


def indexed_text(*columns: str):
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])


def chunk_terms(chunks: DataFrame, key: str = "chunk_id", columns: tuple[str, ...] = ("title", "heading_path", "text")) -> DataFrame:
    """key, term, repeated as often as the term occurs."""
    return chunks.select(key, F.explode(index_terms(indexed_text(*columns))).alias("term"))


def build_index(chunks: DataFrame, key: str = "chunk_id", columns: tuple[str, ...] = ("title", "heading_path", "text")) -> KeywordIndex:
    """The index of ``chunks``; title, headings and text weigh the same."""
    split = chunks.select(key, index_terms(indexed_text(*columns)).alias("terms")).select(key, "terms", F.size("terms").cast("long").alias("length"))
    sized = split.select(key, "length")
    postings = split.select(key, "length", F.explode("terms").alias("term")).groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))
    postings = postings.select("term", key, "tf", "length")
    return KeywordIndex(postings, sized, sized.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")))


def _stems(batches):
    from ..functions.stemmer import stem

    for batch in batches:
        yield batch.assign(stem=[stem(t) for t in batch["term"]])


def stems(terms: DataFrame) -> DataFrame:
    """term, stem of the distinct ``terms`` (term)."""
    return terms.select("term").distinct().mapInPandas(_stems, "term string, stem string")


def stemmed(built: KeywordIndex, key: str = "chunk_id") -> KeywordIndex:
    """The index over stems: each different term is stemmed once, and the postings of terms of one stem are added up."""
    known = cut(stems(built.postings))
    known = F.broadcast(known) if is_small(known, STEMS_SENT) else known
    rows = built.postings.join(known, "term").groupBy(F.col("stem").alias("term"), key, "length").agg(F.sum("tf").alias("tf"))
    return KeywordIndex(rows.select("term", key, "tf", "length"), built.lengths, built.stats)


def fingerprints(documents: DataFrame) -> DataFrame:
    """concept_id, print: a digest of everything that a concept's chunks are made of (all other columns)."""
    columns = sorted(c for c in documents.columns if c != "concept_id")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return documents.select("concept_id", F.sha2(F.concat_ws("\u0001", *parts), 256).alias("print"))


def changed_concepts(now: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(concept_id of what is new or differs, concept_id of that and of what is gone), by fingerprints."""
    same = now.join(before, ["concept_id", "print"], "left_semi").select("concept_id")
    fresh = now.select("concept_id").join(same, "concept_id", "left_anti")
    return fresh, fresh.unionByName(before.select("concept_id").join(now.select("concept_id"), "concept_id", "left_anti"))


#: Parts that stored postings are written in, by a hash of the term.
TERM_PARTS = 64


def term_part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_PARTS)).cast("int")


def document_frequencies(postings: DataFrame) -> DataFrame:
    """term, df."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def replace_rows(table: DataFrame, changed: DataFrame, fresh: DataFrame, key: str = "concept_id") -> DataFrame:
    """``table`` with the rows of the changed keys replaced by ``fresh``: delete, then insert."""
    return table.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)
