"""Frontmatter: the block of YAML before a markdown body, read and rendered.

The part of YAML that frontmatter uses: block maps and lists of any depth, flow
lists and maps on one line, plain and quoted scalars, literal and folded text,
comments. Anchors, tags and several documents are not read; such a block counts
as unparseable, as do tabs for indentation and keys without a colon.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = re.compile(r"\A---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|\Z)", re.DOTALL)
_KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s"'\[\]{},#&*!|>%@`-][^:#]*?|-[^\s:][^:#]*?))\s*:(?:\s+|$)""")
_PLAIN_BAD = re.compile(r"""^$|^[\s"'\[\]{},#&*!|>%@`?:-]|:\s|\s#|:$|\s$|[\x00-\x1f\x7f-\x9f  ﻿]|^(?:~|null|true|false|yes|no|on|off)$|^[-+.]?[\d.]""", re.IGNORECASE)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " ", "e": "\x1b"}


class FrontmatterError(ValueError):
    """A block that cannot be read."""


def _quoted(token: str) -> str:
    if token[0] == "'":
        return token[1:-1].replace("''", "'")
    code = lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else _ESCAPES.get(m[4], m[4])
    return re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))", code, token[1:-1])


def _scalar(token: str) -> Any:
    token = token.strip()
    if token[:1] in "\"'" and token:
        return _quoted(token)
    if token.lower() in ("", "~", "null"):
        return None
    if token.lower() in ("true", "false"):
        return token.lower() == "true"
    if re.fullmatch(r"[-+]?\d+", token):
        return int(token)
    if re.fullmatch(r"[-+]?(?:\d+\.\d*|\.\d+)(?:[eE][-+]?\d+)?", token):
        return float(token)
    if token[0] in "&*!%@`":
        raise FrontmatterError(f"cannot read {token[:20]}")
    return token


class _Flow:
    """A flow value: lists, maps and scalars on one line."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _skip(self) -> str:
        while self.at < len(self.text) and self.text[self.at] in " \t":
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self, inside: bool = False) -> Any:
        c = self._skip()
        if c == "[":
            return self._many("]", lambda: self.value(True))
        if c == "{":
            return dict(self._many("}", self._pair))
        m = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')""").match(self.text, self.at)
        if not m:
            m = re.compile(r"\s*([^,\[\]{}]*)" if inside else r"\s*(.*)").match(self.text, self.at)
        self.at = m.end()
        return _scalar(m[1])

    def _pair(self) -> tuple[str, Any]:
        m = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^:,{}\[\]]+?)\s*:(?=\s|$|["'\[{])""").match(self.text, self.at)
        if not m:
            raise FrontmatterError("a map needs keys")
        self.at = m.end()
        return str(_scalar(m[1])), self.value(True)

    def _many(self, end: str, one) -> list:
        self.at += 1
        out = []
        while self._skip() != end:
            if self.at >= len(self.text):
                raise FrontmatterError(f"{end} is missing")
            out.append(one())
            if self._skip() == ",":
                self.at += 1
            elif self._skip() != end:
                raise FrontmatterError(f"expected , or {end}")
        self.at += 1
        return out


def _uncommented(line: str) -> str:
    """A line without its comment: a # at the beginning or after white space, outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and line[i - 1] != "\\" else quote
        elif c in "\"'" and (not i or line[i - 1] in " \t[{,:"):
            quote = c
        elif c == "#" and (not i or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


class _Block:
    """The lines of a block with their indentation."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        while self.at < len(self.lines):
            line = _uncommented(self.lines[self.at])
            if line.strip():
                indent = len(line) - len(line.lstrip(" "))
                if line[indent] == "\t":
                    raise FrontmatterError("a tab indents")
                return indent, line[indent:]
            self.at += 1
        return None

    def value(self, indent: int) -> Any:
        head = self.peek()
        if head is None or head[0] < indent:
            return None
        if head[1] == "-" or head[1].startswith("- "):
            return self._items(head[0])
        if _KEY.match(head[1]):
            return self._map(head[0])
        self.at += 1
        return self._inline(head[1])

    @staticmethod
    def _inline(text: str) -> Any:
        flow = _Flow(text)
        out = flow.value()
        if flow._skip():
            raise FrontmatterError(f"unexpected {flow.text[flow.at :][:20]}")
        return out

    def _items(self, indent: int) -> list:
        out = []
        while (head := self.peek()) is not None and head[0] == indent and (head[1] == "-" or head[1].startswith("- ")):
            rest = head[1][1:].lstrip()
            if not rest:
                self.at += 1
                out.append(self.value(indent + 1))
                continue
            # what follows the dash is a value at its own column
            column = indent + len(head[1]) - len(rest)
            if _KEY.match(rest) or rest.startswith("- "):
                self.lines[self.at] = " " * column + rest
                out.append(self.value(column))
            elif rest[0] in "|>":
                self.at += 1
                out.append(self._text(indent, rest))
            else:
                self.at += 1
                out.append(self._inline(rest))
        return out

    def _map(self, indent: int) -> dict:
        out: dict[str, Any] = {}
        while (head := self.peek()) is not None and head[0] == indent:
            m = _KEY.match(head[1])
            if not m:
                raise FrontmatterError(f"no key in {head[1][:20]}")
            key = _quoted(f'"{m[1]}"') if m[1] is not None else m[2].replace("''", "'") if m[2] is not None else m[3].strip()
            rest = head[1][m.end() :]
            self.at += 1
            if rest[:1] in ("|", ">") and re.fullmatch(r"[|>][-+]?", rest):
                out[key] = self._text(indent, rest)
            elif rest:
                out[key] = self._inline(rest)
            else:
                below = self.peek()
                out[key] = self.value(indent + 1) if below and below[0] > indent else self._items(indent) if below and below[0] == indent and (below[1] == "-" or below[1].startswith("- ")) else None
        if head is not None and head[0] > indent:
            raise FrontmatterError("a line is indented too far")
        return out

    def _text(self, indent: int, mark: str) -> str:
        lines = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                break
            lines.append(line)
            self.at += 1
        deep = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
        body = "\n".join(x[deep:] for x in lines).rstrip("\n")
        if mark[0] == ">":
            body = re.sub(r"(?<=\S)\n(?=\S)", " ", body)
            body = re.sub(r"\n\n+", lambda m: m[0][1:], body)
        return body + ("" if mark.endswith("-") else "\n")


def parse(text: str | None) -> tuple[dict, str] | None:
    """(frontmatter, body) of a document; None if it has no block or one that cannot be read as a map."""
    m = _BLOCK.match(text or "")
    if not m:
        return None
    try:
        block = _Block((m[1] or "").rstrip("\n"))
        front = block.value(0)
        if block.peek() is not None or not isinstance(front, dict):
            return None
        return front, text[m.end() :]
    except (FrontmatterError, IndexError, ValueError):
        return None


def _in_quotes(text: str) -> str:
    escape = lambda c: {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c) or (c if c.isprintable() else f"\\U{ord(c):08x}")
    return '"' + "".join(map(escape, text)) + '"'


def _rendered_scalar(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    text = str(value)
    if not _PLAIN_BAD.search(text):
        return text
    return _in_quotes(text)


def _lines(value: Any, indent: int) -> Iterator[str]:
    pad = " " * indent
    if isinstance(value, dict):
        for key, item in value.items():
            name = key if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", key) else _in_quotes(str(key))
            if isinstance(item, (dict, list)) and item:
                yield f"{pad}{name}:"
                yield from _lines(item, indent + 2)
            else:
                yield f"{pad}{name}: {'{}' if item == {} and isinstance(item, dict) else '[]' if isinstance(item, list) else _rendered_scalar(item)}"
    else:
        for item in value:
            if isinstance(item, (dict, list)) and item:
                first, *rest = _lines(item, indent + 2)
                yield f"{pad}- {first.lstrip(' ')}"
                yield from rest
            else:
                yield f"{pad}- {'{}' if isinstance(item, dict) else '[]' if isinstance(item, list) else _rendered_scalar(item)}"


def render(front: dict, body: str) -> str:
    """A document in block style, keys in the order they are in; :func:`parse` gives back what went in."""
    return "---\n" + "".join(line + "\n" for line in _lines(front, 0)) + "---\n" + body


def parsed(documents: DataFrame) -> DataFrame:
    """path, front (JSON, null where there is no readable block), body of documents (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [parse(t) for t in batch["text"]]
            yield pd.DataFrame({"path": batch["path"], "front": [json.dumps(r[0], ensure_ascii=False) if r else None for r in read], "body": [r[1] if r else None for r in read]})

    return documents.select("path", "text").mapInPandas(run, "path string, front string, body string")


def frontmatter_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """concept_id, front of the concepts that ``ids`` names; null where the document is missing or cannot be read."""
    wanted = ids.select("concept_id").distinct()
    own = documents.withColumn("concept_id", F.regexp_replace("path", r"\.md$", "")).join(wanted, "concept_id", "left_semi")
    read = parsed(own).select(F.regexp_replace("path", r"\.md$", "").alias("concept_id"), "front")
    return wanted.join(read, "concept_id", "left")
