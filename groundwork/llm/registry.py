"""Queries of this subpackage: name -> plan over (session, directory), and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register ``plan(spark, directory)`` under ``name``."""

    def wrap(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return wrap


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
