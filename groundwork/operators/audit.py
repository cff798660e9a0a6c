"""Audit-trail analyses over (actor, action, ts, origin) rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Working hours are [DAY_START, DAY_END).
DAY_START = 6
DAY_END = 20
# Points per share of unauthorised, off-hours and per distinct origin, and the level limits.
RISK_WEIGHTS: Mapping[str, float] = {"unauthorised": 60.0, "off_hours": 30.0, "origins": 0.1}
RISK_LEVELS: Sequence[tuple[str, float]] = (("HIGH", 35.0), ("MEDIUM", 25.0))


def off_hours(ts: str) -> Column:
    return (F.hour(ts) < DAY_START) | (F.hour(ts) >= DAY_END)


def unauthorised_actions(trail: DataFrame, actions: Sequence[str], allowed: DataFrame) -> DataFrame:
    """Rows with a sensitive action by an actor who is not in ``allowed`` (first column)."""
    sensitive = trail.where(F.col("action").isin(list(actions)))
    return sensitive.join(allowed.select(F.col(allowed.columns[0]).alias("actor")), "actor", "left_anti")


def off_hours_activity(trail: DataFrame) -> DataFrame:
    """(actor, n_actions, n_off_hours, off_hours_ratio) per actor with any off-hours action."""
    return (
        trail.groupBy("actor")
        .agg(F.count("*").alias("n_actions"), F.count_if(off_hours("ts")).alias("n_off_hours"))
        .where(F.col("n_off_hours") > 0)
        .withColumn("off_hours_ratio", F.col("n_off_hours") / F.col("n_actions"))
    )


def origin_rollup(trail: DataFrame) -> DataFrame:
    """(origin, n_actions, n_actors) per origin."""
    return trail.groupBy("origin").agg(
        F.count("*").alias("n_actions"), F.count_distinct("actor").alias("n_actors")
    )


def compliance_ratio(df: DataFrame, group: str | Column, rule: Column) -> DataFrame:
    """(group, n_rows, n_compliant, ratio): share of rows for which ``rule`` holds."""
    key = F.col(group) if isinstance(group, str) else group
    return (
        df.groupBy(key.alias("group"))
        .agg(F.count("*").alias("n_rows"), F.count_if(rule).alias("n_compliant"))
        .withColumn("ratio", F.col("n_compliant") / F.col("n_rows"))
    )


def risk_levels(trail: DataFrame, actions: Sequence[str], allowed: DataFrame) -> DataFrame:
    """(actor, n_actions, n_unauthorised, n_off_hours, n_origins, score, level) per actor.

    The score weighs the shares of unauthorised and off-hours actions and the number of
    origins; actors are summed before they meet the allow-list.
    """
    seen = trail.groupBy("actor").agg(
        F.count("*").alias("n_actions"),
        F.count_if(F.col("action").isin(list(actions))).alias("n_sensitive"),
        F.count_if(off_hours("ts")).alias("n_off_hours"),
        F.count_distinct("origin").alias("n_origins"),
    )
    known = allowed.select(F.col(allowed.columns[0]).alias("actor")).distinct().withColumn("known", F.lit(True))
    n_unauthorised = F.when(F.col("known"), F.lit(0)).otherwise(F.col("n_sensitive"))
    score = (
        RISK_WEIGHTS["unauthorised"] * F.col("n_unauthorised") / F.col("n_actions")
        + RISK_WEIGHTS["off_hours"] * F.col("n_off_hours") / F.col("n_actions")
        + RISK_WEIGHTS["origins"] * F.col("n_origins")
    )
    level = F.lit("LOW")
    for name, limit in reversed(RISK_LEVELS):
        level = F.when(F.col("score") >= limit, name).otherwise(level)
    return (
        seen.join(known, "actor", "left")
        .withColumn("n_unauthorised", n_unauthorised.cast("bigint"))
        .withColumn("score", score)
        .select("actor", "n_actions", "n_unauthorised", "n_off_hours", "n_origins", "score", level.alias("level"))
    )


def telemetry_corr(df: DataFrame, sensor: str, x: str, y: str) -> DataFrame:
    """(sensor, n_rows, x_min, x_max, y_min, y_max, correlation) per sensor."""
    return df.groupBy(F.col(sensor).alias("sensor")).agg(
        F.count("*").alias("n_rows"),
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
        F.min(y).alias("y_min"),
        F.max(y).alias("y_max"),
        F.round(F.corr(x, y), 4).alias("correlation"),
    )
