"""A session with the settings the operators are designed for.

On a cluster the master, memory and ``spark.checkpoint.dir`` come from spark-submit; what is
set here are the engine's own switches.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan from measured sizes: coalesce small partitions, split skewed ones, switch joins.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is worth the extra shuffle that splitting it may need.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build(app: str = "groundwork", master: str | None = None, **extra: str) -> SparkSession:
    """Session with :data:`SETTINGS`; ``extra`` wins, and underscores in its names mean dots."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
