"""References to records that do not exist.

A reference is a tuple of key columns that should name a row of a target table.
References are grouped by null mask (which of their key columns are null); each
mask is anti-joined to the targets on its non-null columns only, under the
declared match semantics:

* ``simple``: a reference with any null column is satisfied, it refers to nothing;
* ``partial``: the non-null columns must occur together in some target row;
* ``full``: a reference is either all null (satisfied) or all non-null and
  present; a mixture of both is an orphan.

An all-null reference is no reference under any of the three. Keys are compared
with ``=``, so empty strings are ordinary values. Repeated references and targets
count once where ``distinct`` is set. An empty target table makes every complete
reference an orphan; an empty reference table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def null_mask(columns: Sequence[str]) -> Column:
    """The null mask of ``columns`` as a string of 1 (value) and 0 (null)."""
    return F.concat(*[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in columns])


def orphan_references(refs: DataFrame, ref_cols: Sequence[str], targets: DataFrame, target_cols: Sequence[str], match: str = "simple") -> DataFrame:
    """The rows of ``refs`` whose key columns name no row of ``targets``.

    Only the key columns of ``targets`` are used, under private names, so other
    columns may clash with those of ``refs``. The targets are reduced to distinct
    keys before they are shuffled; a hot reference key stays on the left of a
    left anti join, which adaptive execution can split.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}, not {match!r}")
    if len(ref_cols) != len(target_cols) or not ref_cols:
        raise ValueError("as many reference columns as target columns, at least one")
    keys = targets.select(*[F.col(f"`{c}`").alias(f"__target_{i}") for i, c in enumerate(target_cols)])
    parts = []
    complete = "1" * len(ref_cols)
    for bits in product("10", repeat=len(ref_cols)):
        mask = "".join(bits)
        if "1" not in mask or (match == "simple" and mask != complete):
            continue
        rows = refs.filter(null_mask(ref_cols) == mask)
        if match == "full" and mask != complete:
            parts.append(rows)
            continue
        used = [i for i, bit in enumerate(mask) if bit == "1"]
        side = keys.select(*[f"__target_{i}" for i in used]).dropna().distinct()
        same = reduce(lambda a, b: a & b, [refs[f"`{ref_cols[i]}`"] == F.col(f"__target_{i}") for i in used])
        parts.append(rows.join(side, same, "left_anti"))
    return reduce(DataFrame.unionByName, parts)


def latest_rows(files: DataFrame) -> DataFrame:
    """The state of each path: its rows with the latest ``last_seen``.

    Instants are compared, not their text, as offsets differ. A ``last_seen``
    that is null or no instant counts as the earliest. Rows that tie for the
    latest are all kept. A path in a third of all rows is reduced to one maximum
    in the map-side aggregation, before anything is shuffled.
    """
    rows = files.select("path", "hash", "scan_status", F.coalesce(F.unix_micros(F.try_to_timestamp("last_seen")), F.lit(-(2**62))).alias("__seen"))
    last = rows.groupBy(F.col("path").alias("__path")).agg(F.max("__seen").alias("__last"))
    return rows.join(last, rows["path"].eqNullSafe(last["__path"]) & (rows["__seen"] == last["__last"])).select("path", "hash", "scan_status")


def normal_hash(column: Column) -> Column:
    """Lower case, without white space and without the ``blake3:`` label."""
    return F.replace(F.regexp_replace(F.lower(column), r"(?U)\s+", ""), F.lit("blake3:"), F.lit(""))


def live_hashes(files: DataFrame) -> DataFrame:
    """Distinct ``target_key``: hashes that some path's latest row holds while it is not missing."""
    rows = latest_rows(files).filter(F.coalesce(F.col("scan_status"), F.lit("")) != "missing")
    return rows.select(normal_hash(F.col("hash")).alias("target_key")).dropna().distinct()


def link_concept(from_id: Column, target: Column) -> Column:
    """The concept id a markdown link means; null where the link is no reference.

    Links to other schemes, mail addresses and anchors, and targets that do not
    end in ``.md`` once fragment and query are cut, are no references. Relative
    targets are read from the directory of ``from_id``; a ``..`` that climbs out
    of the bundle is kept in front, so that it can match no id.
    """
    scheme = reduce(lambda a, b: a | b, [F.startswith(target, F.lit(p)) for p in ("http://", "https://", "mailto:", "file://", "#")])
    plain = F.regexp_replace(target, r"[#?](?s:.*)$", "")
    body = F.substring(plain, F.lit(1), F.length(plain) - 3)
    folder = F.regexp_extract(from_id, r"(?s)^(.*)/[^/]*$", 1)
    full = F.when(F.startswith(body, F.lit("/")), F.regexp_replace(body, "^/+", "")).otherwise(F.concat(folder, F.lit("/"), body))
    parts = F.split(full, "/")
    step = lambda done, part: (
        F.when((part == "") | (part == "."), done)
        .when(part != "..", F.concat(done, F.array(part)))
        .when(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) == "..", F.concat(done, F.array(part)))
        .otherwise(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
    )
    resolved = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~scheme & F.endswith(plain, F.lit(".md")), F.array_join(resolved, "/"))


def catalogue_references(concepts: DataFrame, extracts: DataFrame, links: DataFrame) -> DataFrame:
    """All references of the catalogue: ref_table, ref_key, target_key, at (an instant or null), whether to a hash or a concept."""
    by_hash = concepts.select(F.lit("concepts").alias("ref_table"), F.col("concept_id").alias("ref_key"), normal_hash(F.col("source_hash")).alias("target_key"), F.try_to_timestamp("generated_at").alias("at"))
    by_extract = extracts.select(F.lit("extracts").alias("ref_table"), F.col("extract_path").alias("ref_key"), normal_hash(F.col("hash")).alias("target_key"), F.col("extracted_at").cast("timestamp").alias("at"))
    by_link = links.select(F.lit("links_to").alias("ref_table"), F.col("from_id").alias("ref_key"), link_concept(F.col("from_id"), F.col("target")).alias("target_key"), F.col("seen_at").cast("timestamp").alias("at"))
    return by_hash.unionByName(by_extract).unionByName(by_link)


def catalogue_orphans(files: DataFrame, concepts: DataFrame, extracts: DataFrame, links: DataFrame) -> DataFrame:
    """The references of the catalogue whose target is live nowhere in the data.

    Composite key (kind of target, target key): a reference whose target key is
    null refers to nothing (``match='simple'``). Columns as
    :func:`catalogue_references`.
    """
    kind = F.when(F.col("ref_table") == "links_to", "concept").otherwise("hash")
    live = concepts.filter(F.coalesce(F.col("status"), F.lit("")) != "deprecated").select(F.lit("concept").alias("kind"), F.col("concept_id").alias("target_key"))
    live = live.unionByName(live_hashes(files).select(F.lit("hash").alias("kind"), "target_key"))
    refs = catalogue_references(concepts, extracts, links).withColumn("kind", kind)
    return orphan_references(refs, ["kind", "target_key"], live, ["kind", "target_key"]).drop("kind")


def orphans_by_month(files: DataFrame, concepts: DataFrame, extracts: DataFrame, links: DataFrame) -> DataFrame:
    """Orphan references per referring table and month (UTC; null where the row has no instant)."""
    rows = catalogue_orphans(files, concepts, extracts, links)
    return (
        rows.select("ref_table", "ref_key", "target_key", F.date_format("at", "yyyy-MM").alias("month"))
        .distinct()
        .groupBy("ref_table", "month")
        .agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("target_key").alias("missing_targets"))
    )
