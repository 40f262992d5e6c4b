"""All registered queries and their DuckDB equivalents."""

from __future__ import annotations

from . import functions, graph, knowledge, reports, search, streams, tools, upkeep
from .base import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "functions", "graph", "knowledge", "reports", "search", "streams", "tools", "upkeep"]

FLAGSHIP = search.hybrid_pages
