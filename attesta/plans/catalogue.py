"""All queries on the driver's tables: name to (function, DuckDB SQL or None)."""

from __future__ import annotations

from . import matching_queries, operator_queries, panel_queries, relational_queries, store_queries, text_queries

QUERIES = matching_queries.QUERIES | relational_queries.QUERIES | text_queries.QUERIES | operator_queries.QUERIES | panel_queries.QUERIES | store_queries.QUERIES
