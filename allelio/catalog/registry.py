"""Registered queries: a Spark function over the fixture views and, where SQL can say the same, an oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from allelio.catalog.fixtures import Fixtures, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: list[str] | None = None, sql: str | tuple[str, str] | None = None):
    """Register a function; ``sql`` is the oracle's SELECT, or (SELECT, further recursive WITH terms)."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql is not None:
            body, extra = (sql, "") if isinstance(sql, str) else sql
            ORACLES[name] = with_views(views or [], body, extra=extra)
        return fn

    return register
