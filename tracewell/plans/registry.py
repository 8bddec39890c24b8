"""The library's queries, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tracewell.plans import function_queries, graph_queries, source_queries

_PARTS = (graph_queries, function_queries, source_queries)
QUERIES: dict = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
