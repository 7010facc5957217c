"""The queries of the training-data operators, with their oracle SQL."""

from __future__ import annotations

from tidemark.llm import clustering, decontamination, exact_dedup, fill_in_middle, hmm, html_text, licenses, mixing, near_dedup, packing, quality, sharding, toxicity

MODULES = (toxicity, quality, exact_dedup, hmm, licenses, near_dedup, packing, mixing, sharding, html_text, fill_in_middle, clustering, decontamination)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
