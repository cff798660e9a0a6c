"""Shared folders for checkpoints and intermediate tables.

On a cluster every executor must see the folder, so it always comes from
``spark.checkpoint.dir``. Only a local master may fall back to a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the session; a temporary one only under a local master."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="groundwork-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run of one job."""
    return f"{checkpoint_root(spark)}/groundwork/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` reliably to the shared folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def is_directory(spark: SparkSession, location: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(path).isDirectory()


def make_folder(spark: SparkSession, location: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def list_names(spark: SparkSession, pattern: str) -> list[str]:
    """Last path components matching a Hadoop glob, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    return sorted(status.getPath().getName() for status in found or [])


def file_states(spark: SparkSession, location: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of a file, or of the files of a directory."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)]


def remove_folder(spark: SparkSession, location: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
