"""Ledger reconciliation, large payments and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.operators.joins import with_group_summary

MONEY = "decimal(18,2)"


def ledger_breaks(debits: DataFrame, credits: DataFrame, key: str, tolerance: float = 1.0) -> DataFrame:
    """(key, debit, credit, difference, side) where the two sides differ beyond ``tolerance``.

    Both frames have (key, amount) with decimal amounts and are summed per key before they
    meet, so no key is hot in the join. A key on one side only counts the other as 0.
    """
    d = debits.groupBy(key).agg(F.sum("amount").alias("debit"))
    c = credits.groupBy(key).agg(F.sum("amount").alias("credit"))
    gap = F.coalesce("debit", F.lit(0)) - F.coalesce("credit", F.lit(0))
    side = F.when(F.col("credit").isNull(), "debit only").when(F.col("debit").isNull(), "credit only").otherwise("both")
    return (
        d.join(c, key, "full_outer")
        .withColumn("gap", gap)
        .where(F.abs("gap") > tolerance)
        .select(
            key,
            # Rounded as decimals: halves are exact there.
            F.round("debit", 2).cast("double").alias("debit"),
            F.round("credit", 2).cast("double").alias("credit"),
            F.round("gap", 2).cast("double").alias("difference"),
            side.alias("side"),
        )
    )


def large_disbursements(
    df: DataFrame, ts: str, amount: str, limit: float = 50_000, as_of: str | None = None
) -> DataFrame:
    """Rows above ``limit`` with their ``month``; only the month of ``as_of`` when it is given.

    The month is a range on the timestamp itself, which reaches the Parquet scan.
    """
    large = df.where(F.col(amount) > limit)
    if as_of is not None:
        first = F.trunc(F.lit(as_of).cast("date"), "MM")
        start = first.cast(df.schema[ts].dataType)
        end = F.add_months(first, 1).cast(df.schema[ts].dataType)
        large = large.where((F.col(ts) >= start) & (F.col(ts) < end))
    return large.withColumn("month", F.date_format(ts, "yyyy-MM"))


def zscore_outliers(df: DataFrame, group: str, value: str, z: float = 3.0) -> DataFrame:
    """The rows of ``df`` more than ``z`` sample deviations from their group's mean, with ``z_score``.

    The moments are one aggregate joined back: no group is sorted or gathered, as in a window,
    and the rows of a heavy group stay where they are.
    """
    moments = df.groupBy(group).agg(
        F.count("*").alias("group_rows"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation")
    )
    score = (F.col(value) - F.col("mean")) / F.col("deviation")
    return (
        with_group_summary(df, moments, group, "group_rows")
        .where(F.col("deviation") > 0)
        .withColumn("z_score", score)
        .where(F.abs("z_score") > z)
        .select(*df.columns, F.round("z_score", 4).alias("z_score"))
    )


def value_histogram(df: DataFrame, value: str, low: float, high: float, buckets: int) -> DataFrame:
    """(bucket, bucket_low, n_rows): equal buckets 1..n, 0 below ``low``, n+1 from ``high`` on."""
    width = (high - low) / buckets
    bucket = F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(buckets).cast("bigint"))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(bucket.alias("bucket"))
        .agg(F.count("*").alias("n_rows"))
        .withColumn("bucket_low", F.when(F.col("bucket") >= 1, F.round(low + (F.col("bucket") - 1) * width, 6)))
    )
