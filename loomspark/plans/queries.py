"""All queries of the library but those of the training-data subpackage."""

from __future__ import annotations

from loomspark.plans import import_queries, search_queries, state_queries, text_queries

QUERIES = text_queries.QUERIES | search_queries.QUERIES | state_queries.QUERIES | import_queries.QUERIES
ORACLE_SQL = text_queries.SQL | search_queries.SQL | state_queries.SQL | import_queries.SQL
