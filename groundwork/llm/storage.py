"""Intermediate tables and row identities."""

from __future__ import annotations

from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.sources.scratch import remove_folder, scratch_dir


#: Tables written by this driver and not yet removed.
_MADE: list[str] = []


def made() -> list[str]:
    """The intermediate tables that are there now."""
    return list(_MADE)


def remove(spark: SparkSession, tables: list[str]) -> None:
    """Remove intermediate tables that nothing will read again."""
    for path in tables:
        remove_folder(spark, path)
        _MADE.remove(path)


#: Spark's setting for the bytes of a batch that goes to a Python worker, and what :func:`small_batches` makes it.
BATCH_BYTES, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


@contextmanager
def small_batches(spark: SparkSession):
    """What runs meanwhile sends rows to Python workers about 4 MB at a time, unless the session has a bound of its own.

    By default a batch is 10,000 rows, however long. Buffers of tens of megabytes are held by both
    sides at once, and the JVM's allocator seldom gives them back.
    """
    if spark.conf.get(BATCH_BYTES, None) is not None:
        yield
        return
    spark.conf.set(BATCH_BYTES, SMALL)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES)


def stored(df: DataFrame, name: str, long_rows: bool = False) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and read from there.

    The files outlive lost executors and the rows never change again, whatever is computed twice.
    ``long_rows`` says that whole texts or sets go to Python workers: then in :func:`small_batches`.
    """
    path = scratch_dir(df.sparkSession, name)
    _MADE.append(path)
    with small_batches(df.sparkSession) if long_rows else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Summaries of up to this many groups are broadcast. A group with more than one part in this many
#: of all rows is heavy, so there are never more heavy groups than that either.
HEAVY = 10_000


def with_summary(df: DataFrame, summary: DataFrame, key: str, rows: str) -> DataFrame:
    """``df`` inner-joined with one ``summary`` row per ``key``; ``rows`` counts the group's rows.

    The summary is written once. Heavy groups join by broadcast, so their rows never meet in one
    task; the others, all small, by shuffle.
    """
    summary = stored(summary, "summary")
    size = summary.agg(F.count("*").alias("groups"), F.sum(rows).alias("rows")).first()
    if size["groups"] <= HEAVY:
        return df.join(F.broadcast(summary), key)
    is_heavy = F.col(rows) * HEAVY > size["rows"]
    heavy = F.broadcast(summary.where(is_heavy))
    rest = df.join(heavy.select(key), key, "left_anti").join(summary.where(~is_heavy), key)
    return df.join(heavy, key).unionByName(rest)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def content_key(text) -> list:
    """Columns that are equal exactly for equal texts: SHA-256, length and a second hash."""
    whole = F.coalesce(text, F.lit(""))
    return [
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("sha"),
        F.octet_length(whole).cast("long").alias("bytes"),
        F.xxhash64(whole).alias("check"),
    ]


KEY = ["sha", "bytes", "check"]

#: Up to this many row identities are broadcast, about 100 bytes each.
BROADCAST_ROWS = 200_000


def identity(id_column: str, text_column: str):
    """What a decision about a row goes by: its identifier, if it has one, and its whole text; missing identifiers come last."""
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    return F.struct(F.col(id_column).isNull().alias("unknown"), F.col(id_column).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"))


def without_rows(docs: DataFrame, gone: DataFrame, id_column: str, text_column: str, kind: str = "left_anti") -> DataFrame:
    """``docs``, all columns, without the rows whose :func:`identity` is the column ``own`` of ``gone``.

    Few identities are broadcast, so that no text is moved; more than :data:`BROADCAST_ROWS` meet
    the rows by a shuffle join. ``kind`` "left_semi" gives the other rows.
    """
    gone = stored(gone.select(F.col("own.id").alias("id"), F.col("own.sha").alias("sha")).distinct(), "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = F.unhex(F.sha2(F.coalesce(docs[text_column], F.lit("")).cast("binary"), 256))
    same = docs[id_column].eqNullSafe(gone["id"]) & (own == gone["sha"])
    return docs.join(F.broadcast(gone) if few else gone, same, kind)
