"""All queries of the engine and the SQL they are checked against."""

from __future__ import annotations

from loomspan.plans import corpus, documents, enrich, hierarchy, knowledge, records, search, text

MODULES = (search, corpus, text, documents, enrich, knowledge, hierarchy, records)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
