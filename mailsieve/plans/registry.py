"""Registry of named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_clause

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, oracle: str | None = None,
          ctes: dict[str, str] | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``.  ``covers`` lists inventory identifiers."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers.split()
        if oracle is not None:
            ORACLES[name] = with_clause(oracle, ctes)
        return fn
    return add
