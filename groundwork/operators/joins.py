"""Joining rows with a summary of their own groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.sources.scratch import checkpointed

# Summaries of up to this many groups are broadcast. A group holding more than one part in
# this many of all rows is heavy, so there are never more heavy groups than that either.
BROADCAST_GROUPS = 10_000


def with_group_summary(df: DataFrame, summary: DataFrame, key: str, rows: str) -> DataFrame:
    """``df`` inner-joined with one ``summary`` row per ``key``; ``rows`` counts the group's rows.

    The summary is computed once, into the shared checkpoint folder, and its size decides.
    Adaptive execution does not split a hot key when the other side is an aggregate on that
    key, so with many groups the heavy ones are broadcast on their own: their rows never
    move, and the groups that join by shuffle are all small.
    """
    summary = checkpointed(summary)
    size = summary.agg(F.count("*").alias("groups"), F.sum(rows).alias("rows")).first()
    if size["groups"] <= BROADCAST_GROUPS:
        return df.join(F.broadcast(summary), key)
    is_heavy = F.col(rows) * BROADCAST_GROUPS > size["rows"]
    heavy = F.broadcast(summary.where(is_heavy))
    hot = df.join(heavy, key)
    rest = df.join(heavy.select(key), key, "left_anti").join(summary.where(~is_heavy), key)
    return hot.unionByName(rest)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``position``, its place from 1 in a total order, without gathering the rows.

    Rows are range-partitioned and written once; what is summed is one count per partition.
    """
    row = F.monotonically_increasing_id()
    kept = checkpointed(df.orderBy(*order).withColumn("__row", row))
    part = F.shiftrightunsigned("__row", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).select(
        "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")
    )
    # The low 33 bits count the rows of a partition from 0.
    place = F.col("__start") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    joined = kept.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.withColumn("position", place.cast("int")).select(*df.columns, "position")
