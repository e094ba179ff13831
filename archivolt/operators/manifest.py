"""The file census as a state machine: upserts, missing files, pending work, catalogue records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import CONCEPT_COLUMNS



def upsert_stat(old: DataFrame, seen: DataFrame, run_id: str, now: str) -> DataFrame:
    """The census after a scan.

    ``seen`` has path, root, ext, size, inode, mtime, mime, scan_status. A path
    whose size, mtime and inode are what they were keeps hash, extraction status
    and extraction path; first_seen is kept, word count and engine are not
    cleared. A path without a stat result (denied, unreadable) is stored with
    size, mtime and inode 0, and so loses its hash. Paths not seen stay as they are.
    """
    stat = F.col("s.scan_status").isin("denied", "unreadable")
    number = lambda c: F.when(stat, F.lit(0)).otherwise(F.col(f"s.{c}"))
    same = F.col("o.path").isNotNull() & (F.col("o.size") == number("size")) & (F.col("o.mtime") == number("mtime")) & (F.col("o.inode") == number("inode"))
    new = F.col("s.path").isNotNull()
    kept = lambda c: F.when(new & ~F.coalesce(same, F.lit(False)), None).otherwise(F.col(f"o.{c}"))
    return old.alias("o").join(seen.alias("s"), F.col("o.path") == F.col("s.path"), "full_outer").select(
        F.coalesce("s.path", "o.path").alias("path"),
        *[F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("root", "ext", "mime", "scan_status")],
        *[F.when(new, number(c)).otherwise(F.col(f"o.{c}")).alias(c) for c in ("size", "inode", "mtime")],
        kept("hash").alias("hash"),
        F.coalesce(kept("extract_status"), F.lit("pending")).alias("extract_status"),
        kept("extract_path").alias("extract_path"),
        F.col("o.extract_engine").alias("extract_engine"),
        F.col("o.word_count").alias("word_count"),
        F.when(new, F.lit(run_id)).otherwise(F.col("o.run_id")).alias("run_id"),
        F.coalesce("o.first_seen", F.lit(now)).alias("first_seen"),
        F.when(new, F.lit(now)).otherwise(F.col("o.last_seen")).alias("last_seen"),
    )


#: The record of a run: what, when, and what came of it (JSON).
RUNS = "run_id string, command string, started_at string, finished_at string, stats string"


def start_run(runs: DataFrame, run_id: str, command: str, now: str) -> DataFrame:
    """``runs`` with a run that has begun; one of that id that is there is begun anew."""
    new = runs.sparkSession.createDataFrame([(run_id, command, now, None, None)], RUNS)
    return runs.filter(F.col("run_id") != run_id).unionByName(new)


def finish_run(runs: DataFrame, run_id: str, now: str, stats: str) -> DataFrame:
    """``runs`` with the run's end and its statistics."""
    own = F.col("run_id") == run_id
    return runs.withColumn("finished_at", F.when(own, F.lit(now)).otherwise(F.col("finished_at"))).withColumn("stats", F.when(own, F.lit(stats)).otherwise(F.col("stats")))


def unfinished_runs(runs: DataFrame) -> DataFrame:
    """The runs that began and did not end, the newest first: what a stage is resumed from."""
    return runs.filter(F.col("started_at").isNotNull() & F.col("finished_at").isNull()).orderBy(F.desc("started_at"), "run_id")


def under(path: Column, root: Column) -> Column:
    """Whether a path is a root or lies below it; a sibling whose name begins alike does not."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def mark_missing(files: DataFrame, run_id: str, roots: list[str]) -> DataFrame:
    """Files below the scanned roots that the run did not see become ``missing``."""
    scanned = F.lit(False)
    for root in roots:
        scanned = scanned | under(F.col("path"), F.lit(root))
    gone = scanned & (F.coalesce("run_id", F.lit("")) != run_id)
    return files.withColumn("scan_status", F.when(gone, "missing").otherwise(F.col("scan_status")))


def needs_hash(files: DataFrame) -> DataFrame:
    """Included files without a hash, the smallest first."""
    return files.filter((F.col("scan_status") == "included") & F.col("hash").isNull()).orderBy("size", "path")


def pending_extractions(files: DataFrame) -> DataFrame:
    """One row for each included hash that awaits extraction: the row of its first path, and how many copies there are."""
    rows = files.filter((F.col("scan_status") == "included") & (F.col("extract_status") == "pending") & F.col("hash").isNotNull())
    one = rows.groupBy("hash").agg(F.min_by(F.struct("path", "ext", "mime", "size"), "path").alias("r"), F.count(F.lit(1)).alias("copies"))
    return one.select("hash", "r.path", "r.ext", "r.mime", "r.size", "copies")


def representatives(files: DataFrame) -> DataFrame:
    """One row for each hash of included files: the row of its first path, and the number of copies."""
    rows = files.filter((F.col("scan_status") == "included") & F.col("hash").isNotNull())
    return rows.groupBy("hash").agg(F.min("path").alias("path"), F.min_by("size", "path").alias("size"), F.min_by("ext", "path").alias("ext"), F.count(F.lit(1)).alias("copies"))


def set_extract_result(files: DataFrame, results: DataFrame) -> DataFrame:
    """Results by hash (hash, status, extract_path, engine, word_count, error) applied to every path that holds it."""
    r = results.select("hash", *[F.col(c).alias(f"__{c}") for c in ("status", "extract_path", "engine", "word_count", "error")])
    done = F.col("__status").isNotNull()
    names = {"extract_status": "__status", "extract_path": "__extract_path", "extract_engine": "__engine", "word_count": "__word_count", "error": "__error"}
    rows = files.join(r, "hash", "left")
    return rows.select(*[F.when(done, F.col(names[c])).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in files.columns])


def save_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records after an enrichment: new values win, but an id once given stays."""
    columns = [c for c in CONCEPT_COLUMNS if c in old.columns and c != "source_hash"]
    rows = old.alias("o").join(new.alias("n"), F.col("o.source_hash") == F.col("n.source_hash"), "full_outer")
    fresh = F.col("n.source_hash").isNotNull()
    pick = [F.coalesce("o.concept_id", "n.concept_id").alias("concept_id")] + [F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns if c != "concept_id"]
    return rows.select(F.coalesce("n.source_hash", "o.source_hash").alias("source_hash"), *pick)


def enrichable(files: DataFrame, records: DataFrame) -> DataFrame:
    """Included, extracted hashes without a finished record: hash, path, last_seen (latest of its copies)."""
    rows = files.filter((F.col("scan_status") == "included") & (F.col("extract_status") == "ok") & F.col("hash").isNotNull())
    one = rows.groupBy("hash").agg(F.min("path").alias("path"), F.max("last_seen").alias("last_seen"))
    state = records.select(F.col("source_hash").alias("hash"), "enrich_status")
    return one.join(state, "hash", "left").filter(F.coalesce("enrich_status", F.lit("")) != "ok").select("hash", "path", "last_seen", "enrich_status")


def enriched_concepts(files: DataFrame, records: DataFrame) -> DataFrame:
    """Finished records with the first included path of their hash."""
    one = representatives(files).select(F.col("hash").alias("source_hash"), "path", "size")
    return records.filter(F.col("enrich_status") == "ok").join(one, "source_hash")


def to_deprecate(files: DataFrame, records: DataFrame) -> DataFrame:
    """Records that are not deprecated though no included file holds their hash."""
    live = files.filter((F.col("scan_status") == "included") & F.col("hash").isNotNull()).select(F.col("hash").alias("source_hash")).distinct()
    return records.filter(F.coalesce("status", F.lit("stable")) != "deprecated").join(live, "source_hash", "left_anti")


def to_restore(files: DataFrame, records: DataFrame) -> DataFrame:
    """Deprecated records whose hash an included file holds again."""
    live = files.filter((F.col("scan_status") == "included") & F.col("hash").isNotNull()).select(F.col("hash").alias("source_hash")).distinct()
    return records.filter(F.col("status") == "deprecated").join(live, "source_hash", "left_semi")
