"""The property graph as tables: nodes, edges, duplicates, hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import directory, is_file_like
from .catalogue import concept_entities, concept_tags, live_concepts
from .orphans import link_concept


def concept_nodes(concepts: DataFrame) -> DataFrame:
    rows = live_concepts(concepts)
    return rows.select("concept_id", F.col("concept_type").alias("type"), "title", "description", "sensitivity", "status", "source_hash", "ingest_run", F.col("model").alias("generated_by"), "generated_at", directory(F.col("concept_id")).alias("directory"))


def mentions(concepts: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """concept_id, key, name, kind: every mention of an entity that is no file's name; keys that ``aliases`` (alias_key, key) maps are replaced."""
    rows = concept_entities(live_concepts(concepts)).filter(~is_file_like(F.col("name")))
    if aliases is None:
        return rows
    mapped = aliases.select(F.col("alias_key").alias("key"), F.col("key").alias("__to"))
    return rows.join(mapped, "key", "left").withColumn("key", F.coalesce("__to", "key")).drop("__to")


def entity_nodes(concepts: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """key, name (of the first concept), kind, occurrence_count (mentions, repeated ones too), first_seen (the earliest), documents."""
    rows = mentions(concepts, aliases).join(live_concepts(concepts).select("concept_id", F.expr("nullif(generated_at, '')").alias("__at")), "concept_id")
    return rows.groupBy("key").agg(
        F.min_by("name", F.struct("concept_id", "name")).alias("name"), F.min("kind").alias("kind"), F.count(F.lit(1)).alias("occurrence_count"), F.min(F.try_to_timestamp("__at")).alias("first_seen"), F.countDistinct("concept_id").alias("documents")
    )


def tag_nodes(concepts: DataFrame) -> DataFrame:
    return concept_tags(live_concepts(concepts)).groupBy("tag").agg(F.count(F.lit(1)).alias("concept_count"))


def mention_edges(concepts: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    return mentions(concepts, aliases).select("concept_id", "key").distinct()


def tag_edges(concepts: DataFrame) -> DataFrame:
    return concept_tags(live_concepts(concepts)).distinct()


def file_nodes(files: DataFrame, concepts: DataFrame) -> DataFrame:
    """hash, path (the first), ext, size, mtime of the hashes that concepts are derived from, whatever their scan status."""
    used = live_concepts(concepts).select(F.col("source_hash").alias("hash"))
    rows = files.filter(F.col("hash").isNotNull()).join(used, "hash", "left_semi")
    return rows.groupBy("hash").agg(F.min("path").alias("path"), F.min_by("ext", "path").alias("ext"), F.min_by("size", "path").alias("size"), F.min_by("mtime", "path").alias("mtime"))


def derived_edges(files: DataFrame, concepts: DataFrame) -> DataFrame:
    """concept_id, hash of the concepts whose file is known."""
    known = files.filter(F.col("hash").isNotNull()).select(F.col("hash").alias("source_hash")).distinct()
    return live_concepts(concepts).join(known, "source_hash", "left_semi").select("concept_id", F.col("source_hash").alias("hash"))


def resolved_links(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """from_id, to_id, known: the distinct links of live concepts, and whether they lead to a live concept other than themselves."""
    live = live_concepts(concepts).select("concept_id")
    rows = links.select("from_id", link_concept(F.col("from_id"), F.col("target")).alias("to_id")).dropna().distinct()
    rows = rows.join(live.withColumnRenamed("concept_id", "from_id"), "from_id", "left_semi").filter(F.col("from_id") != F.col("to_id"))
    return rows.join(live.select(F.col("concept_id").alias("to_id"), F.lit(True).alias("known")), "to_id", "left").select("from_id", "to_id", F.coalesce("known", F.lit(False)).alias("known"))


def link_edges(links: DataFrame, concepts: DataFrame) -> DataFrame:
    return resolved_links(links, concepts).filter("known").select("from_id", "to_id")


def broken_links(links: DataFrame, concepts: DataFrame) -> DataFrame:
    return resolved_links(links, concepts).filter("NOT known").select("from_id", "to_id")


def child_edges(ids: DataFrame) -> DataFrame:
    """child, parent: each id with the nearest of its ancestors (by path) that is an id too."""
    parts = F.split("concept_id", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = ids.select("concept_id").distinct().filter(F.size(parts) > 1).select(F.col("concept_id").alias("child"), F.explode(above).alias("parent"))
    known = rows.join(ids.select(F.col("concept_id").alias("parent")).distinct(), "parent", "left_semi")
    return known.groupBy("child").agg(F.max_by("parent", F.length("parent")).alias("parent"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).union(edges.select("to_id", "from_id")).distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """qid, concept_id: what is within ``hops`` links of the seeds (qid, concept_id), either way, without the seeds."""
    near = both_ways(edges)
    seen = at = seeds.select("qid", "concept_id").distinct()
    for _ in range(max(hops, 0)):
        at = at.join(near, at["concept_id"] == near["a"]).select("qid", F.col("b").alias("concept_id")).distinct()
        seen = seen.unionByName(at).distinct()
    return seen.join(seeds.select("qid", "concept_id"), ["qid", "concept_id"], "left_anti")


def shared_neighbours(edges: DataFrame, start: str, node: str = "key") -> DataFrame:
    """concept_id, via: the other concepts that share a node (edges concept_id -> ``node``) with ``start``."""
    mine = edges.filter(F.col("concept_id") == start).select(F.col(node).alias("via")).distinct()
    return edges.select("concept_id", F.col(node).alias("via")).join(mine, "via").filter(F.col("concept_id") != start).distinct().select("concept_id", "via")


def traverse(start: str, links: DataFrame, named: dict[str, DataFrame], hops: int = 1, limit: int = 50) -> DataFrame:
    """concept_id, reasons: neighbours by links (within 1 or 2 hops) and by shared nodes, those with most reasons first."""
    seed = links.sparkSession.createDataFrame([(0, start)], "qid int, concept_id string")
    rows = neighbours(links, seed, min(max(hops, 1), 2)).select("concept_id", F.lit("LINKS_TO").alias("reason"))
    for label, edges in named.items():
        node = next(c for c in edges.columns if c != "concept_id")
        rows = rows.unionByName(shared_neighbours(edges, start, node).select("concept_id", F.concat(F.lit(label + ":"), "via").alias("reason")))
    out = rows.distinct().groupBy("concept_id").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))
    return out.orderBy(F.desc(F.size("reasons")), "concept_id").limit(min(max(limit, 1), 200))


def duplicate_candidates(nodes: DataFrame) -> DataFrame:
    """key_a, key_b, reason: names of one kind of which one holds all words of the other, or an e-mail address whose
    local part names the other. ``nodes`` has key, name, kind. Pairs are found by equal words, never by a cross join."""
    words = F.array_distinct(F.filter(F.split(F.lower("name"), r"[^\p{L}\p{N}_]+"), lambda t: t != ""))
    mail = F.trim("name").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
    base = nodes.select("key", "kind", "name", words.alias("words"), mail.alias("mail")).distinct()
    plain = base.filter(~F.col("mail"))
    # a contained name shares its rarest word: one equality per contained name, not one per word
    each = plain.select("kind", "key", F.size("words").alias("n"), F.explode("words").alias("w"))
    rare = each.join(each.groupBy("kind", "w").agg(F.count(F.lit(1)).alias("df")), ["kind", "w"])
    rarest = rare.groupBy("kind", "key").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
    short = plain.join(rarest, ["kind", "key"]).select("kind", "w", F.col("key").alias("a"), F.col("words").alias("wa"))
    long = plain.select("kind", F.explode("words").alias("w"), F.col("key").alias("b"), F.col("words").alias("wb"))
    inside = short.join(long, ["kind", "w"]).filter((F.col("a") != F.col("b")) & (F.size("wa") < F.size("wb")) & (F.size(F.array_except("wa", "wb")) == 0))
    inside = inside.select("a", "b", F.lit("contained").alias("reason"))

    local = F.filter(F.split(F.lower(F.regexp_extract("name", "^([^@]+)@", 1)), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    mails = base.filter("mail").select("kind", F.col("key").alias("a"), F.explode(local).alias("part")).distinct()
    others = F.array_sort("words")
    initial = F.transform("words", lambda w: F.struct(w.alias("w"), F.try_element_at(F.filter(others, lambda x: x != w), F.lit(1)).alias("o")))
    calls = F.concat(F.col("words"), F.transform(F.filter(initial, lambda p: (F.length(p["w"]) > 2) & p["o"].isNotNull()), lambda p: F.concat(F.substring(p["o"], 1, 1), p["w"])))
    named = plain.select("kind", F.col("key").alias("b"), F.explode(calls).alias("part")).distinct()
    by_mail = mails.join(named, ["kind", "part"]).select("a", "b", F.lit("email").alias("reason"))
    rows = inside.unionByName(by_mail).distinct()
    return rows.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"), "reason").distinct()


def numbered_rows(down: list[str], up: list[str]) -> Column:
    """The number of a row, for tables of few rows: by ``down`` from the greatest, then by ``up`` from the least."""
    return F.row_number().over(Window.orderBy(*[F.desc(c) for c in down], *up))


#: What speaks more strongly for one and the same entity.
REASONS = ("contained", "email")


def review_order(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """key_a, key_b, reason, rank, occurrences, place: candidates as they are to be reviewed, the strongest reason first,
    then the most mentioned. ``nodes`` has key, occurrence_count."""
    count = lambda side: nodes.select(F.col("key").alias(f"key_{side}"), F.col("occurrence_count").alias(f"__{side}"))
    rank = F.coalesce(*[F.when(F.col("reason") == r, n) for n, r in enumerate(REASONS, 1)], F.lit(0))
    rows = pairs.join(count("a"), "key_a").join(count("b"), "key_b").select("key_a", "key_b", "reason", rank.alias("rank"), (F.col("__a") + F.col("__b")).alias("occurrences"))
    return rows.orderBy(F.desc("rank"), F.desc("occurrences"), "key_a", "key_b", "reason")


def co_occurrences(edges: DataFrame) -> DataFrame:
    """key_a < key_b, together: in how many concepts two entities stand together (edges concept_id, key)."""
    a, b = edges.select("concept_id", F.col("key").alias("key_a")), edges.select("concept_id", F.col("key").alias("key_b"))
    return a.join(b, "concept_id").filter(F.col("key_a") < F.col("key_b")).groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("together"))


def first_per(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")
