"""The table of registered queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from detlake.catalog.views import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: list[str] | None = None):
    """Register a query; ``sql`` is its oracle over ``views``, none means rows only."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(views or [], sql)
        return fn

    return add


def rounded(col, digits: int):
    """Rounded double without a negative zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, digits) + F.lit(0.0)
