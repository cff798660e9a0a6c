"""Tables kept as numbered version directories.

A version is written whole to its own directory and becomes visible through Spark's
``_SUCCESS`` marker, so no reader ever sees a half-written table and no job overwrites
what it is reading.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from groundwork.sources.scratch import list_names, make_folder

def complete_versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/_SUCCESS")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(path) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def version_path(root: str, version: int) -> str:
    return f"{root}/version={version:010d}"


def read_latest(spark: SparkSession, root: str, below: int | None = None) -> DataFrame | None:
    """Newest complete version, or the newest one older than ``below``."""
    versions = [v for v in complete_versions(spark, root) if below is None or v < below]
    return spark.read.parquet(version_path(root, versions[-1])) if versions else None


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """Name of the run that a streaming checkpoint belongs to; a new checkpoint gets a new one."""
    found = list_names(spark, f"{checkpoint}/run/*")
    if found:
        return found[0]
    name = uuid.uuid4().hex
    make_folder(spark, f"{checkpoint}/run/{name}")
    return name


def claim_version(spark: SparkSession, root: str, claimant: str) -> int:
    """The version ``claimant`` writes: the one it claimed before if nothing newer is complete, else the next."""
    newest = max(complete_versions(spark, root), default=-1)
    claimed = [int(name) for name in list_names(spark, f"{root}/claims/{claimant}/*")]
    if claimed and max(claimed) >= newest:
        return max(claimed)
    version = newest + 1
    make_folder(spark, f"{root}/claims/{claimant}/{version:010d}")
    return version


def append(df: DataFrame, path: str) -> None:
    """Add rows to a fact table that is only ever added to."""
    df.write.mode("append").parquet(path)


def publish(df: DataFrame, root: str, version: int) -> str:
    """Write ``df`` as the given version; repeating a failed attempt starts it over."""
    path = version_path(root, version)
    df.write.mode("overwrite").parquet(path)
    return path
