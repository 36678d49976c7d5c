"""All queries of the engine by name, each with the SQL that an independent engine can run."""

from __future__ import annotations

from . import array_queries, bootstrap_queries, fusion_queries, metric_queries, model_queries, ordered_queries, relational_queries, selection_queries, source_queries

_MODULES = (metric_queries, relational_queries, selection_queries, source_queries, ordered_queries, bootstrap_queries, array_queries, model_queries, fusion_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
