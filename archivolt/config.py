"""Settings of the engine, with their defaults; read from TOML where a file is given."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path

from .functions.globs import DENY


@dataclass(frozen=True)
class Scan:
    roots: tuple[str, ...] = ()
    deny: tuple[str, ...] = DENY
    max_file_bytes: int = 104_857_600
    include_source_code: bool = False


@dataclass(frozen=True)
class Extract:
    min_chars: int = 30
    thin_chars: int = 100
    thin_fraction: float = 0.6
    sample_pages: int = 8
    max_pages: int = 40


@dataclass(frozen=True)
class Enrich:
    prompt_words: int = 2000
    max_tags: int = 6
    max_entities: int = 12
    max_attempts: int = 2


@dataclass(frozen=True)
class Bundle:
    max_related: int = 8
    link_rarity_ceiling: int = 60
    min_link_score: float = 0.35


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 800
    overlap_ratio: float = 0.15


@dataclass(frozen=True)
class Retrieval:
    vector_top_k: int = 50
    bm25_top_k: int = 50
    rrf_k: int = 60
    fuse_top_n: int = 20
    graph_hops: int = 1
    graph_neighbour_chunks: int = 2
    rerank_max_candidates: int = 30
    limit: int = 15
    weak_score: float = 0.2


@dataclass(frozen=True)
class Watch:
    debounce_seconds: float = 3.0
    max_queue: int = 5000
    drain_max: int = 200


@dataclass(frozen=True)
class Config:
    warehouse: str = "warehouse"
    scan: Scan = field(default_factory=Scan)
    extract: Extract = field(default_factory=Extract)
    enrich: Enrich = field(default_factory=Enrich)
    bundle: Bundle = field(default_factory=Bundle)
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    watch: Watch = field(default_factory=Watch)


def _merged(default, values: dict):
    known = {f.name for f in fields(default)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    changes = {}
    for key, value in values.items():
        own = getattr(default, key)
        changes[key] = _merged(own, value) if is_dataclass(own) else tuple(value) if isinstance(own, tuple) else value
    return replace(default, **changes)


def load_questions(path: str | Path) -> list[tuple[str, str, list[str]]]:
    """(id, question, expected concept ids) of a TOML file of ``[[question]]`` tables with ``id``, ``text`` and
    ``expect``; a question without ``expect`` has no answer in the catalogue."""
    with open(path, "rb") as fh:
        items = tomllib.load(fh).get("question", [])
    out = []
    for n, item in enumerate(items, 1):
        if not str(item.get("text", "")).strip():
            raise ValueError(f"question {n} has no text")
        out.append((str(item.get("id", n)), item["text"].strip(), [str(c) for c in item.get("expect", [])]))
    return out


def load_aliases(path: str | Path) -> list[tuple[str, str]]:
    """(alias key, key) of a TOML file with one table for each kind: ``[person]``, ``"canonical name" = ["alias", ...]``."""
    with open(path, "rb") as fh:
        kinds = tomllib.load(fh)
    key = lambda kind, name: f"{kind.lower()}:{' '.join(name.split()).lower().replace('ß', 'ss')}"
    rows = [(key(kind, a), key(kind, name)) for kind, names in kinds.items() for name, aliases in names.items() for a in aliases]
    if twice := sorted({a for a, _ in rows if len({k for b, k in rows if b == a}) > 1}):
        raise ValueError(f"an alias of two names: {', '.join(twice)}")
    return sorted(set(rows))


def load(path: str | Path | None = None) -> Config:
    """The settings of a TOML file over the defaults; unknown names are errors."""
    if path is None:
        return Config()
    with open(path, "rb") as fh:
        return _merged(Config(), tomllib.load(fh))
