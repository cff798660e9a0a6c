"""The registry the driver's entry module exposes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundwork.sources.tables import Tables, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``plan(tables) -> DataFrame`` under ``name``, with its SQL twin if there is one."""

    def wrap(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, directory: plan(load(spark, directory))
        if sql is not None:
            SQL[name] = sql
        return plan

    return wrap


def with_views(*views: str, select: str) -> str:
    """``WITH a AS (...), b AS (...) select``; each view is a "name AS (...)" text."""
    return "WITH " + ",\n".join(views) + "\n" + select
