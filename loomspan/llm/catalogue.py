"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from loomspan.llm import queries_holds, queries_messages, queries_more, queries_text, queries_vectors

MODULES = (queries_text, queries_messages, queries_more, queries_vectors, queries_holds)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
