"""Registry of the queries outside the llm subpackage."""

from __future__ import annotations

from loomgraph.plans import annotation_queries, graph_queries, lookup_queries, source_queries, table_queries, tidy_queries

QUERIES = {**graph_queries.QUERIES, **table_queries.QUERIES, **source_queries.QUERIES, **annotation_queries.QUERIES, **lookup_queries.QUERIES, **tidy_queries.QUERIES}
ORACLE_SQL = {**graph_queries.ORACLE_SQL, **table_queries.ORACLE_SQL, **source_queries.ORACLE_SQL, **annotation_queries.ORACLE_SQL, **lookup_queries.ORACLE_SQL, **tidy_queries.ORACLE_SQL}
