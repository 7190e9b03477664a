"""All queries over the given tables and their SQL."""

from __future__ import annotations

from cueloom.plans import cue_queries, inventory_queries, job_queries, store_queries

MODULES = (cue_queries, store_queries, inventory_queries, job_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
