"""Registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Named SQL views shared by the oracle statements, in order of dependence.
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def with_views(sql: str) -> str:
    """Prefix a statement with the shared views it uses, directly or not."""
    needed: set[str] = set()
    texts = [sql]
    while texts:
        text = texts.pop()
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                texts.append(body)
    parts = [f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed]
    if not parts:
        return sql.strip()
    return "WITH RECURSIVE " + ", ".join(parts) + " " + sql.strip()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the shared views."""

    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return keep
