"""All queries of the library's own operators, with their oracle SQL."""

from __future__ import annotations

from tidemark.plans import core_queries, flow_queries, graph_queries, more_queries, text_queries

MODULES = (core_queries, text_queries, graph_queries, flow_queries, more_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
