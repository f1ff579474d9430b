"""Registration of named queries with their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landwatch.sources.fixtures import Tables, oracle

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under its name, next to SQL over the named views."""

    def wrap(fn):
        name = fn.__name__
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = oracle(views, sql)
        return fn

    return wrap
