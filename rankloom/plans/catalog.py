"""All named queries of the retrieval operators, and their SQL twins."""

from __future__ import annotations

from rankloom.plans import arm_queries, asked_queries, evidence_queries, selection_queries, text_queries, vector_queries

_ALL = {**text_queries.QUERIES, **vector_queries.QUERIES, **evidence_queries.QUERIES, **selection_queries.QUERIES, **arm_queries.QUERIES, **asked_queries.QUERIES}


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
