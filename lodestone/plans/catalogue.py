"""All queries of the engine itself: name -> callable, and name -> DuckDB SQL."""

from __future__ import annotations

from lodestone.plans import graph_queries, more_queries, text_queries

QUERIES: dict = {**graph_queries.QUERIES, **text_queries.QUERIES, **more_queries.QUERIES}
ORACLE_SQL: dict = {**graph_queries.ORACLE_SQL, **text_queries.ORACLE_SQL, **more_queries.ORACLE_SQL}
