"""Bundles of markdown documents: rendering with frontmatter, writing, reading."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bundle import front_value, parse_frontmatter


def quoted(value: Column) -> Column:
    """A YAML scalar in double quotes."""
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def rendered(bodies: DataFrame, records: DataFrame) -> DataFrame:
    """path, text: documents (concept_id, body) with the frontmatter of their records; absent keys are left out."""
    keys = {"type": "concept_type", "title": "title", "description": "description", "sensitivity": "sensitivity", "status": "status", "source_hash": "source_hash", "generated_at": "generated_at", "ingest_run": "ingest_run"}
    lines = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k}: "), quoted(F.col(c)))) for k, c in keys.items()]
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("- "), quoted(t))), "\n")))
    front = F.array_join(F.array_compact(F.array(*lines, tags)), "\n")
    rows = bodies.join(records.select("concept_id", *keys.values(), "tags"), "concept_id")
    return rows.select(F.concat("concept_id", F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), front, F.lit("\n---\n"), "body", F.lit("\n")).alias("text"))


def write_bundle(documents: DataFrame, folder: str) -> None:
    """Write documents (path, text) as a table partitioned by their top folder; the committer replaces it as a whole."""
    documents.withColumn("top", F.substring_index("path", "/", 1)).write.mode("overwrite").partitionBy("top").parquet(folder)


def confined(folder: str, path: str) -> str:
    """``path`` below ``folder``, with links and ``..`` resolved; an error if it leads out of it."""
    root = os.path.realpath(folder)
    whole = os.path.realpath(os.path.join(root, path))
    if whole != root and not whole.startswith(root + os.sep):
        raise ValueError(f"{path} leads out of {folder}")
    return whole


def write_atomic(folder: str, path: str, text: str) -> str:
    """Write a file below ``folder`` so that readers see the old or the new one, never a part."""
    whole = confined(folder, path)
    os.makedirs(os.path.dirname(whole), exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=os.path.dirname(whole), prefix=".", suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as fh:
            fh.write(text)
            fh.flush()
            os.fsync(fh.fileno())
        os.replace(beside, whole)
    except BaseException:
        os.unlink(beside)
        raise
    return whole


#: What a new folder of notes begins with.
SCAFFOLD = {"index.md": "# Index\n", "{slug}/index.md": "# {slug}\n\n## Decisions\n\n- None.\n\n## Open questions\n\n- None.\n", "{slug}/sessions/.keep": ""}


def init_folder(folder: str, slug: str) -> list[str]:
    """Lay out a folder of notes for a project; the files that were made. Nothing that is there is touched."""
    if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", slug):
        raise ValueError(f"{slug!r} is no slug")
    made = []
    for name, text in SCAFFOLD.items():
        whole = confined(folder, name.format(slug=slug))
        os.makedirs(os.path.dirname(whole), exist_ok=True)
        try:
            with open(whole, "x", encoding="utf-8") as fh:
                fh.write(text.format(slug=slug))
            made.append(whole)
        except FileExistsError:
            continue
    return made


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """path (within ``folder``), text of all markdown files of a folder tree."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    base = "/" + folder.split("://")[-1].strip("/") + "/"
    path = F.regexp_replace(F.try_url_decode(F.replace(F.expr("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^[a-z]+:/*", "/")
    return rows.select(F.replace(path, F.lit(base), F.lit("")).alias("path"), F.col("value").alias("text"))


def concepts_of(documents: DataFrame) -> DataFrame:
    """concept_id, type, title, description, status, source_hash, body of the documents that parse, without deprecated and reserved ones."""
    name = F.regexp_replace("path", "^.*/", "")
    rows = documents.filter(~name.isin("index.md", "log.md", "entity-review.md")).select("path", parse_frontmatter(F.col("text")).alias("p")).filter("p IS NOT NULL")
    keys = ("type", "title", "description", "status", "source_hash")
    rows = rows.select(F.regexp_replace("path", r"\.md$", "").alias("concept_id"), *[front_value(F.col("p.front"), k).alias(k) for k in keys], F.col("p.body").alias("body"))
    return rows.filter(F.col("status") != "deprecated")
