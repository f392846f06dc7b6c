"""Every query by name, with the SQL that another engine runs for the same result."""

from __future__ import annotations

from bookflow import queries_features, queries_live, queries_tables

QUERIES: dict = {**queries_features.QUERIES, **queries_tables.QUERIES, **queries_live.QUERIES}
ORACLE_SQL: dict = {**queries_features.ORACLE_SQL, **queries_tables.ORACLE_SQL, **queries_live.ORACLE_SQL}
