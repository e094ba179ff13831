"""Catalogue records from texts: the prompt, the default rule-based enricher, and the cleaning of what an enricher says."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, fold_case, is_file_like

TYPES = ("Runbook", "Design Doc", "Specification", "Plan", "Meeting Notes", "Contract", "Legal Document", "Financial Record", "Reference", "Report", "Correspondence", "Marketing Copy", "Data Export", "Source Notes", "Other")
KINDS = ("person", "organization", "system", "project")
MAX_TAGS, MAX_ENTITIES, PROMPT_WORDS = 6, 12, 2000
RECORD = "struct<title:string,description:string,concept_type:string,tags:array<string>,entities:array<struct<name:string,kind:string>>,sensitivity:string>"


def response_schema() -> dict:
    """The JSON schema of what an enricher is to say, with the allowed values and sizes; for engines that can be bound to one."""
    text = {"type": "string"}
    entity = {"type": "object", "properties": {"name": text, "kind": {"type": "string", "enum": list(KINDS)}}, "required": ["name", "kind"], "additionalProperties": False}
    fields = {
        "title": {**text, "maxLength": 120}, "description": {**text, "maxLength": 400}, "concept_type": {"type": "string", "enum": list(TYPES)},
        "tags": {"type": "array", "items": text, "maxItems": MAX_TAGS}, "entities": {"type": "array", "items": entity, "maxItems": MAX_ENTITIES}, "sensitivity": {"type": "string", "enum": ["work", "personal"]},
    }
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def excerpt(text: Column, words: int = PROMPT_WORDS) -> Column:
    """The first ``words`` words of a text."""
    return F.array_join(F.slice(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), 1, words), " ")


def ordered_distinct(items: Column, key: Callable[[Column], Column]) -> Column:
    """``items`` without those whose key an earlier one has."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def clean_record(raw: Column, fallback_title: Column, forced: Column | None = None, default: str = "personal") -> Column:
    """What an enricher said (a :data:`RECORD`), with white space collapsed, lengths, types, kinds and repetition in bounds."""
    title = F.substring(collapse(F.coalesce(raw["title"], F.lit(""))), 1, 120)
    kind = F.trim(F.coalesce(raw["concept_type"], F.lit("")))
    tag = lambda t: F.regexp_replace(collapse(F.lower(F.coalesce(t, F.lit("")))), r"^[ \-_/]+|[ \-_/]+$", "")
    tags = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(raw["tags"], F.array().cast("array<string>")), tag), lambda t: t != "")), 1, MAX_TAGS)
    entity = lambda e: F.struct(collapse(F.coalesce(e["name"], F.lit(""))).alias("name"), F.lower(F.coalesce(e["kind"], F.lit(""))).alias("kind"))
    ents = F.transform(F.coalesce(raw["entities"], F.array().cast("array<struct<name:string,kind:string>>")), entity)
    ents = F.filter(ents, lambda e: (e["name"] != "") & e["kind"].isin(*KINDS) & ~is_file_like(e["name"]))
    ents = F.slice(ordered_distinct(ents, lambda e: F.concat(fold_case(e["name"]), F.lit("|"), e["kind"])), 1, MAX_ENTITIES)
    said = F.lower(F.coalesce(raw["sensitivity"], F.lit("")))
    sensitivity = F.when(said.isin("work", "personal"), said).otherwise(default)
    return F.struct(
        F.when(title == "", fallback_title).otherwise(title).alias("title"), F.substring(collapse(F.coalesce(raw["description"], F.lit(""))), 1, 400).alias("description"), F.when(kind.isin(*TYPES), kind).otherwise("Other").alias("concept_type"),
        tags.alias("tags"), ents.alias("entities"), (F.coalesce(forced, sensitivity) if forced is not None else sensitivity).alias("sensitivity"),
    )


def rule_based(name: str, text: str) -> dict:
    """The default enricher, without a model: first line, first sentence, commonest long words, capitalised names."""
    lines = [line.strip("# *|") for line in text.split("\n") if line.strip("# *|-")]
    words = Counter(w for w in re.findall(r"[^\W\d_]{5,}", text.lower()))
    names = Counter(m for m in re.findall(r"\b[A-ZÄÖÜ][^\W\d_]+ [A-ZÄÖÜ][^\W\d_]+\b", text))
    kind = next((t for t in TYPES if t.lower().split()[0] in text.lower()), "Other")
    sentence = re.split(r"(?<=[.!?])\s", " ".join(lines[1:] or lines), maxsplit=1)[0] if lines else ""
    return {"title": lines[0] if lines else name, "description": sentence, "concept_type": kind, "tags": [w for w, _ in words.most_common(MAX_TAGS)], "entities": [{"name": n, "kind": "person"} for n, _ in names.most_common(MAX_ENTITIES)], "sensitivity": ""}


def enrich(texts: DataFrame, enricher: Callable[[str, str], dict] = rule_based, attempts: int = 2) -> DataFrame:
    """source_hash, enrich_status, error and the cleaned record of texts (source_hash, name, text). An enricher that
    fails ``attempts`` times leaves an empty record with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            out = []
            for h, name, text in zip(batch["source_hash"], batch["name"], batch["text"]):
                said, error = None, None
                for _ in range(attempts):
                    try:
                        said, error = json.dumps(enricher(name or "", text or "")), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                out.append((h, name, said, error))
            yield pd.DataFrame(out, columns=["source_hash", "name", "said", "error"])

    rows = texts.select("source_hash", "name", "text").mapInPandas(run, "source_hash string, name string, said string, error string")
    rows = rows.withColumn("r", clean_record(F.from_json("said", RECORD), F.coalesce("name", F.lit("untitled"))))
    return rows.select("source_hash", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("enrich_status"), "error", "r.*")
