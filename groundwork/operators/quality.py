"""Constraint checks: uniqueness, column rules, references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_rows) of every key that occurs more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def not_null(column: str) -> Column:
    return F.col(column).isNotNull()


def in_set(column: str, allowed: Sequence) -> Column:
    return F.col(column).isin(list(allowed))


def between(column: str, low, high) -> Column:
    return F.col(column).between(low, high)


def fits_precision(column: str, precision: int, scale: int) -> Column:
    """The value survives rounding to ``scale`` digits within ``precision`` digits in all.

    Its size decides in most rows; only near the limit it is cast, since a failing cast is slow.
    """
    limit = 10.0 ** (precision - scale)
    size = F.abs(F.col(column).try_cast("double"))
    exact = F.col(column).try_cast(T.DecimalType(precision, scale)).isNotNull()
    return F.col(column).isNull() | F.when(size > limit * 1.001, F.lit(False)).when(size < limit * 0.999, F.lit(True)).otherwise(exact)


def check_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n_rows, n_violations), all rules in one pass.

    A rule is violated where it is false; an unknown (NULL) outcome passes, as in a CHECK.
    """
    names = list(rules)
    counts = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(~F.coalesce(rule, F.lit(True))).alias(f"rule_{i}") for i, rule in enumerate(rules.values())],
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.col("n_rows"), F.col(f"rule_{i}").alias("n_violations"))
            for i, name in enumerate(names)
        ]
    )
    return counts.select(F.inline(rows))


def fk_orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(key, n_rows): referenced keys without a parent row; a NULL reference is no orphan.

    Both sides are reduced to their keys before the join, so a hot key travels as one row per task.
    """
    referenced = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("key")).agg(
        F.count("*").alias("n_rows")
    )
    return referenced.join(parent.select(F.col(parent_key).alias("key")).distinct(), "key", "left_anti")


# Where an agent may be deployed.
DEPLOYMENT_TARGETS = ("HYBRID", "DB_NATIVE", "GCP_CONTAINER")


def contract_rules() -> dict[str, Column]:
    """Rules of the result contract every agent execution returns."""
    required = ("executionId", "agentId", "agentName", "domain", "deploymentTarget", "data")
    rules = {f"{name} present": not_null(name) for name in required}
    rules["deploymentTarget known"] = in_set("deploymentTarget", DEPLOYMENT_TARGETS)
    rules["confidence in [0, 1]"] = between("metadata.confidence", 0, 1)
    rules["latencyMs not negative"] = F.col("metadata.latencyMs") >= 0
    return rules


def contract_violations(results: DataFrame) -> DataFrame:
    return check_report(results, contract_rules())
