"""Meeting exports: reading, rendering, importing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import date_prefix, title_slug

MEETING = "struct<id:string,title:string,created_at:string,date:string,attendees:array<string>,summary:string,notes:string,duration_minutes:int,transcript:array<struct<speaker:string,text:string>>>"


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Meetings of JSON exports: a list, or a list under ``meetings`` or ``results``."""
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<meetings:array<{MEETING}>,results:array<{MEETING}>>")
    bare = F.from_json("value", f"array<{MEETING}>")
    listed = F.when(F.ltrim("value").startswith("["), bare).otherwise(F.coalesce(wrapped["meetings"], wrapped["results"]))
    return raw.select(F.explode(listed).alias("m")).select("m.*")


def has_content() -> Column:
    """Whether there is more than a title: a summary, notes or a transcript."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return filled("summary") | filled("notes") | (F.coalesce(F.size("transcript"), F.lit(0)) > 0)


def file_name() -> Column:
    day = date_prefix(F.coalesce("created_at", "date", F.lit("")))
    return F.concat(F.when(F.coalesce(day, F.lit("")) != "", F.concat(day, F.lit("-"))).otherwise(""), title_slug(F.coalesce("title", F.lit(""))), F.lit(".md"))


def _trimmed(c: str) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def meeting_markdown(source: str = "Export") -> Column:
    """One meeting as markdown; sections without content are left out."""
    title = F.when(_trimmed("title") != "", _trimmed("title")).otherwise("Untitled meeting")
    stamp = F.substring(F.coalesce("created_at", "date", F.lit("")), 1, 10)
    people = F.array_join(F.filter("attendees", lambda a: F.coalesce(a, F.lit("")) != ""), ", ")
    facts = F.array(
        F.when(stamp != "", F.concat(F.lit("**Date:** "), stamp)), F.when(F.coalesce(people, F.lit("")) != "", F.concat(F.lit("**Attendees:** "), people)),
        F.when(F.coalesce("duration_minutes", F.lit(0)) != 0, F.concat(F.lit("**Duration:** "), F.col("duration_minutes").cast("string"), F.lit(" minutes"))), F.lit(f"**Source:** {source}"),
    )
    section = lambda name, c: F.when(_trimmed(c) != "", F.concat(F.lit(f"## {name}\n\n"), _trimmed(c)))
    turn = lambda t: F.concat(F.lit("**"), F.coalesce(F.expr("nullif(trim(''), '')"), F.when(F.trim(F.coalesce(t["speaker"], F.lit(""))) != "", F.trim(t["speaker"])).otherwise("Unknown")), F.lit(":** "), F.trim(t["text"]))
    turns = F.transform(F.filter("transcript", lambda t: F.trim(F.coalesce(t["text"], F.lit(""))) != ""), turn)
    spoken = F.when(F.coalesce(F.size(turns), F.lit(0)) > 0, F.concat(F.lit("## Transcript\n\n"), F.array_join(turns, "\n\n")))
    head = F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(F.array_compact(facts), "\n"))
    return F.concat(F.concat_ws("\n\n", head, section("Summary", "summary"), section("Notes", "notes"), spoken), F.lit("\n"))


def import_outcome(meetings: DataFrame, present: DataFrame) -> DataFrame:
    """file, content, outcome: imported, updated, unchanged or skipped against what is ``present`` (file, content)."""
    new = meetings.select(file_name().alias("file"), has_content().alias("filled"), meeting_markdown().alias("content"))
    new = new.groupBy("file").agg(F.max("filled").alias("filled"), F.max_by("content", F.struct("filled", "content")).alias("content"))
    rows = new.join(present.select("file", F.col("content").alias("old")), "file", "left")
    outcome = F.when(~F.col("filled"), "skipped").when(F.col("old").isNull(), "imported").when(F.col("old") == F.col("content"), "unchanged").otherwise("updated")
    return rows.select("file", "content", outcome.alias("outcome"))


def transcript_markdown(turns: DataFrame, key: str, order: list[str], speaker: str, text: str) -> DataFrame:
    """key, body: the turns of each meeting as markdown, in order."""
    row = F.struct(*order, F.concat(F.lit("**"), F.coalesce(speaker, F.lit("Unknown")), F.lit(":** "), text).alias("__line"))
    return turns.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["__line"]), "\n\n").alias("body"))
