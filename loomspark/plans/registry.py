"""Queries of the engine's own operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its DuckDB SQL where SQL can say it."""
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    for m in ("catalog", "retrieval", "texts", "documents", "endtoend", "topics", "helpers", "sync", "mutations", "evaluation", "scans", "clusters"):
        import_module(f"loomspark.plans.{m}")
