"""Text from files' bytes: pluggable extractors with the errors of one file kept to that file."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count

#: Bytes that are looked at to tell text from binary, and the share of control characters that text may have.
SNIFF, CONTROL_SHARE, LOST_SHARE = 8192, 0.05, 0.05
MIN_CHARS = 30
_CONTROL = frozenset(range(32)) - {9, 10, 12, 13, 27} | {127}


@dataclass
class Extracted:
    status: str
    text: str = ""
    engine: str = ""
    error: str | None = None


def looks_binary(raw: bytes) -> bool:
    """A zero byte, or too many control characters among the first bytes."""
    head = raw[:SNIFF]
    return b"\0" in head or (bool(head) and sum(b in _CONTROL for b in head) > CONTROL_SHARE * len(head))


def plain_text(raw: bytes) -> Extracted:
    """Text by byte order mark, then UTF-8, then Latin-1; line ends made line feeds."""
    if not raw.strip():
        return Extracted("empty", engine="plain")
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    marked = next((code for mark, code in marks if raw.startswith(mark)), None)
    if marked is None and looks_binary(raw):
        return Extracted("failed", engine="plain", error="binary content")
    for code in ([marked] if marked else []) + ["utf-8", "latin-1"]:
        try:
            text = raw.decode(code)
        except UnicodeDecodeError:
            continue
        if text.count("�") > LOST_SHARE * max(len(text), 1):
            return Extracted("failed", engine="plain", error="undecodable text")
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        return Extracted("ok" if text.strip() else "empty", text, "plain")
    return Extracted("failed", engine="plain", error="undecodable text")


def html_text(raw: bytes) -> Extracted:
    """The text of an HTML page."""
    read = plain_text(raw)
    if read.status != "ok":
        return Extracted(read.status, engine="html", error=read.error)
    s = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?(</\1\s*>|$)", " ", read.text)
    s = re.sub(r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n", s)
    s = unescape(re.sub(r"(?s)<[^>]*>", " ", s))
    s = "\n".join(filter(None, (" ".join(line.split()) for line in s.split("\n"))))
    return Extracted("ok" if s else "empty", s, "html")


def unavailable(name: str) -> Callable[[bytes], Extracted]:
    """An engine that is not installed here."""

    def run(raw: bytes) -> Extracted:
        raise RuntimeError(f"{name} is not available")

    return run


#: Engines of each extension in the order they are tried; callers may put in their own.
CHAINS: dict[str, list[tuple[str, Callable[[bytes], Extracted]]]] = {ext: [("html", html_text)] for ext in (".html", ".htm", ".xhtml")}
ROUTES: dict[str, Callable[[bytes], Extracted]] = {"plain": plain_text, "pdf": unavailable("a PDF engine"), "image": unavailable("an OCR engine")}


def first_success(raw: bytes, ext: str) -> Extracted:
    """The first engine of the extension's chain that gives text; all errors joined if none does."""
    errors = []
    for name, engine in CHAINS.get(ext, []):
        try:
            out = engine(raw)
            if out.status == "ok":
                return out
            errors.append(f"{name}: {out.error or out.status}")
        except Exception as e:
            errors.append(f"{name}: {type(e).__name__}: {e}")
    return Extracted("failed", engine="office", error=(" | ".join(errors) or f"no engine for {ext}")[:600])


def extract_bytes(raw: bytes | None, ext: str | None, route: str) -> Extracted:
    """One file; whatever goes wrong is in the result."""
    try:
        if raw is None:
            return Extracted("failed", engine=route, error="no content")
        if route == "office":
            return first_success(raw, ext or "")
        if route in ROUTES:
            return ROUTES[route](raw)
        return Extracted("skipped", engine="none", error=f"no route for {ext}")
    except Exception as e:
        return Extracted("failed", engine=route, error=f"{type(e).__name__}: {e}")


def extract(files: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """hash, status, text, engine, error, word_count of files (hash, ext, route, content); once for each hash.
    Texts shorter than ``min_chars`` are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [extract_bytes(raw, ext, route) for raw, ext, route in zip(batch["content"], batch["ext"], batch["route"])]
            yield pd.DataFrame({"hash": batch["hash"], "status": [r.status for r in out], "text": [r.text for r in out], "engine": [r.engine for r in out], "error": [r.error for r in out]})

    one = files.filter("hash IS NOT NULL").dropDuplicates(["hash"]).select("hash", "ext", "route", "content")
    rows = one.mapInPandas(run, "hash string, status string, text string, engine string, error string")
    short = (F.col("status") == "ok") & (F.length(F.trim("text")) < min_chars)
    return rows.withColumn("status", F.when(short, "empty").otherwise(F.col("status"))).withColumn("word_count", word_count(F.col("text")).cast("bigint"))


def group_lines(boxes: list[tuple[float, float, str]], tolerance: float = 0.012) -> list[str]:
    """Lines of recognised fragments (x, y centre, text), top to bottom: a fragment joins the first line whose centre
    is within ``tolerance`` of its own; in a line fragments stand from left to right."""
    lines: list[tuple[float, list[tuple[float, str]]]] = []
    for x, y, text in sorted(boxes, key=lambda b: -b[1]):
        home = next((parts for centre, parts in lines if abs(centre - y) <= tolerance), None)
        if home is None:
            lines.append((y, [(x, text)]))
        else:
            home.append((x, text))
    return [" ".join(t for _, t in sorted(parts, key=lambda p: p[0])) for _, parts in lines]
