"""Named queries over an Archive, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.sources.views import Archive, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of an Archive as a query."""

    def add(build: Callable[[Archive], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Archive(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return build

    return add
