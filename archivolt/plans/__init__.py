"""Registered queries of the engine's own operators."""

from . import engine_queries, function_queries, graph_queries, manifest_queries, orphan_queries, search_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
