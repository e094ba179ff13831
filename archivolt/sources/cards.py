"""Session cards: closed JSON records, validated by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bundle import bullets

SCALARS = ("id", "project", "occurred_at", "tool", "source_ref", "status", "summary")
LISTS = ("decisions", "artifacts", "open_loops", "lesson_keys")
STATUSES = ("completed", "paused", "blocked")
MOST_BYTES = 262_144
SCHEMA = "struct<" + ",".join([f"{c}:string" for c in SCALARS] + [f"{c}:array<string>" for c in LISTS]) + ">"
_SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"


def card_errors(raw: Column) -> Column:
    """array<string>: what is wrong with the JSON text of a card, the gravest first; empty if nothing is."""
    card = F.from_json(raw, SCHEMA)
    unknown = F.array_sort(F.array_except(F.json_object_keys(raw), F.array(*[F.lit(c) for c in SCALARS + LISTS])))
    errors = [F.when(F.octet_length(raw) > MOST_BYTES, "more bytes than a card may have"), F.when(F.json_object_keys(raw).isNull(), "no JSON object"), F.when(F.size(unknown) > 0, F.concat(F.lit("fields that no card has: "), F.array_join(unknown, ", ")))]
    for c in SCALARS:
        errors.append(F.when(F.trim(F.coalesce(card[c], F.lit(""))) == "", f"{c} is missing or blank"))
    for c in ("id", "project"):
        value = F.trim(card[c])
        errors.append(F.when((value != "") & (~value.rlike(_SLUG) | (F.length(value) > 120)), f"{c} is no slug (small letters, digits and single hyphens, at most 120)"))
    at = F.trim(card["occurred_at"])
    aware = at.rlike(r"(Z|[+-]\d\d:?\d\d)$") & F.try_to_timestamp(at).isNotNull()
    errors.append(F.when((at != "") & ~F.coalesce(aware, F.lit(False)), "occurred_at is no ISO 8601 instant with a zone"))
    errors.append(F.when((F.trim(card["status"]) != "") & ~F.trim(card["status"]).isin(*STATUSES), "status is none of completed, paused and blocked"))
    for c in LISTS:
        members = F.transform(card[c], lambda m: F.trim(F.coalesce(m, F.lit(""))))
        errors.append(F.when(F.exists(members, lambda m: m == ""), f"{c} has a blank member"))
        errors.append(F.when(F.size(F.array_distinct(members)) < F.size(members), f"{c} names a member twice"))
    return F.array_compact(F.array(*errors))


def valid_cards(rows: DataFrame, raw: str = "value") -> DataFrame:
    """The cards of the rows without errors, as columns."""
    card = F.from_json(raw, SCHEMA)
    good = rows.filter(F.size(card_errors(F.col(raw))) == 0)
    lists = [F.coalesce(F.transform(card[c], F.trim), F.array().cast("array<string>")).alias(c) for c in LISTS]
    return good.select(*[F.trim(card[c]).alias(c) for c in SCALARS], *lists)


def card_path() -> Column:
    """``project/sessions/year-month/id.md``; the month is that of the card's own zone."""
    return F.concat_ws("/", "project", F.lit("sessions"), F.substring("occurred_at", 1, 7), F.concat("id", F.lit(".md")))


def card_markdown() -> Column:
    parts = [F.lit("# "), F.col("summary"), F.lit("\n\n"), F.concat(F.lit("- Tool: "), "tool", F.lit("\n- Source: "), "source_ref", F.lit("\n- Status: "), "status", F.lit("\n- When: "), "occurred_at", F.lit("\n"))]
    for c in LISTS:
        parts += [F.lit(f"\n## {c.replace('_', ' ').capitalize()}\n\n"), bullets(F.col(c)), F.lit("\n")]
    return F.concat(*parts)


def capture_outcome(cards: DataFrame, present: DataFrame) -> DataFrame:
    """path, content, outcome: captured, repeated or conflict against what is ``present`` (path, content); nothing is overwritten."""
    new = cards.select(card_path().alias("path"), card_markdown().alias("content")).distinct()
    rows = new.join(present.select("path", F.col("content").alias("old")), "path", "left")
    return rows.select("path", "content", F.when(F.col("old").isNull(), "captured").when(F.col("old") == F.col("content"), "repeated").otherwise("conflict").alias("outcome"))
