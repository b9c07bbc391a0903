"""The named queries of the engine and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from newsflow.plans import analytics, coverage, relational

QUERIES = {**relational.QUERIES, **analytics.QUERIES, **coverage.QUERIES}
ORACLE_SQL = {**relational.ORACLE_SQL, **analytics.ORACLE_SQL, **coverage.ORACLE_SQL}
