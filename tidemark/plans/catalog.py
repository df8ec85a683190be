"""Registration of queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None):
    """Register a query under its function name; ``covers`` lists inventory rows."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        COVERS[fn.__name__] = covers
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register
