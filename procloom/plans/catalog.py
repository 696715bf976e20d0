"""All queries of the engine by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from procloom.plans import fact_queries, file_queries, graph_queries, model_queries, review_queries, state_queries, text_queries
from procloom.plans.registry import Query

_MODULES = (text_queries, fact_queries, graph_queries, state_queries, review_queries, file_queries, model_queries)
QUERIES: dict[str, Query] = {name: f for m in _MODULES for name, f in m.R.queries.items()}
SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.R.sql.items()}
FLAGSHIP = "greedy_batches_by_source"
