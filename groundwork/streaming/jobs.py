"""Continuous log ingest, running counters and streaming upserts.

Every job keeps its progress in ``checkpoint`` (a shared folder) and can be restarted there.
Sinks are idempotent by batch id: a replayed batch replaces what its first attempt wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundwork.operators.telemetry import classify, parse_logs
from groundwork.operators.upsert import catalog_upsert, latest_per_key, provision
from groundwork.sources.buckets import BucketedTable
from groundwork.sources.scratch import list_names, remove_folder
from groundwork.sources.versions import claim_version, publish, read_latest, run_of


def read_feed(spark: SparkSession, in_dir: str, schema: str, files: str = "*.parquet", per_batch: int = 1000) -> DataFrame:
    """Append-only file feed: the files of ``in_dir`` matching ``files``, as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", per_batch)
        .parquet(in_dir)
    )


def read_lines(spark: SparkSession, in_dir: str, files: str = "*", per_batch: int = 1000) -> DataFrame:
    """Raw log feed: the lines of text files as (line, file), as the files arrive.

    Spark's own file source reads them, from any store it can reach, and its checkpoint says which files
    a batch holds, so a replayed batch holds the same lines. A file must be complete when it appears.
    """
    return (
        spark.readStream.option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", per_batch)
        .text(in_dir)
        .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    )


def _started(writer, continuous: str | None) -> StreamingQuery:
    """Run until the present input is used up, or forever at a fixed interval."""
    return (writer.trigger(availableNow=True) if continuous is None else writer.trigger(processingTime=continuous)).start()


def stream_logs(feed: DataFrame, line: str, out_dir: str, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
    """Parse and classify each log line and append it to Parquet; no state is kept."""
    parsed = classify(parse_logs(feed, line))
    writer = parsed.writeStream.format("parquet").outputMode("append")
    return _started(writer.option("path", out_dir).option("checkpointLocation", checkpoint), continuous)


def stream_agent_counts(
    feed: DataFrame,
    ts: str,
    agent: str,
    out_dir: str,
    checkpoint: str,
    window: str = "1 day",
    continuous: str | None = None,
    compact_every: int = 50,
) -> StreamingQuery:
    """Running count and newest event per (tumbling window, agent).

    Every batch writes its own partial counters, one directory per batch, and keeps no state, so
    events count however late they come. A replayed batch replaces its directory; a new
    checkpoint, which reads the feed from its start, counts into a directory of its own.
    :func:`read_agent_counts` adds the partial counters up. Every ``compact_every`` batches the earlier ones
    are merged into a base, so a reader never adds up more than that many batches and one base.
    """
    spark = feed.sparkSession
    run = run_of(spark, checkpoint)
    mine = [name for name in list_names(spark, f"{out_dir}/run=*") if name.endswith(run)]
    place = mine[0] if mine else f"run={len(list_names(spark, f'{out_dir}/run=*')):010d}-{run}"

    def save(batch: DataFrame, batch_id: int) -> None:
        counts = (
            batch.withColumn("event_time", F.col(ts).cast("timestamp"))
            .groupBy(F.window("event_time", window).alias("w"), F.col(agent).alias("agent_id"))
            .agg(F.count("*").alias("invocations"), F.max("event_time").alias("last_execution"))
            .select(F.col("w.start").alias("window_start"), "agent_id", "invocations", "last_execution")
        )
        counts.write.mode("overwrite").parquet(f"{out_dir}/{place}/batch_id={batch_id}")
        if batch_id and batch_id % compact_every == 0:
            compact_agent_counts(spark, out_dir, place)

    return _started(feed.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint), continuous)


def _counter_parts(spark: SparkSession, folder: str) -> tuple[int, list[int]]:
    """(last batch in the newest complete base or -1, the batches after it)."""
    bases = [name for name in list_names(spark, f"{folder}/base=*") if list_names(spark, f"{folder}/{name}/_SUCCESS")]
    base = max((int(name.split("=")[1]) for name in bases), default=-1)
    batches = sorted(int(name.split("=")[1]) for name in list_names(spark, f"{folder}/batch_id=*"))
    return base, [b for b in batches if b > base]


def _added(spark: SparkSession, folder: str, base: int, batches: list[int]) -> DataFrame:
    paths = [f"{folder}/batch_id={b}" for b in batches] + ([f"{folder}/base={base:012d}"] if base >= 0 else [])
    return (
        spark.read.parquet(*paths)
        .groupBy("window_start", "agent_id")
        .agg(F.sum("invocations").alias("invocations"), F.max("last_execution").alias("last_execution"))
    )


def compact_agent_counts(spark: SparkSession, out_dir: str, run: str | None = None) -> int | None:
    """Merge all but the newest batch of a run into a base; the last batch it holds, or None.

    A batch can be replayed only while it is the newest, so what a base holds never changes again. The base
    counts once it is complete; until then, and if its writer fails, readers use the old one. What the base
    before it replaced is removed, so a reader that has just listed the folder still finds its files.
    """
    folder = f"{out_dir}/{run or list_names(spark, f'{out_dir}/run=*')[-1]}"
    base, batches = _counter_parts(spark, folder)
    if len(batches) < 2:
        return None
    last = batches[-2]
    _added(spark, folder, base, batches[:-1]).write.mode("overwrite").parquet(f"{folder}/base={last:012d}")
    for name in list_names(spark, f"{folder}/batch_id=*"):
        if int(name.split("=")[1]) <= base:
            remove_folder(spark, f"{folder}/{name}")
    for name in list_names(spark, f"{folder}/base=*"):
        if int(name.split("=")[1]) < base:
            remove_folder(spark, f"{folder}/{name}")
    return last


def read_agent_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """(window_start, agent_id, invocations, last_execution) of the newest run: its base and the batches after it."""
    folder = f"{out_dir}/{list_names(spark, f'{out_dir}/run=*')[-1]}"
    return _added(spark, folder, *_counter_parts(spark, folder))


def stream_upsert(
    feed: DataFrame,
    table_root: str,
    checkpoint: str,
    order_by: list[str],
    as_of: Callable[[], Column],
    continuous: str | None = None,
) -> StreamingQuery:
    """Upsert each batch of provisioned agents into the versioned catalogue at ``table_root``.

    A catalogue kept in buckets (:mod:`groundwork.sources.buckets`) has only the buckets rewritten that a
    batch touches; one kept whole is written whole.

    The catalogue keeps the ordering columns, and only a change that is not older than the stored
    one is applied, so the order of the batches does not matter. Every batch of a checkpoint has a
    version of its own, after all that are there; a replay rebuilds that version as long as it is
    the newest.
    """
    run = run_of(feed.sparkSession, checkpoint)

    def newer(target: DataFrame, source: DataFrame) -> DataFrame:
        """The changes that are not older than what the table holds."""
        if order_by[0] not in target.columns:
            return source
        known = target.where(F.col(order_by[0]).isNotNull()).select("agent_id", F.struct(*order_by).alias("__stored"))
        fresh = source.join(known, "agent_id", "left").where(
            F.col("__stored").isNull() | (F.struct(*order_by) >= F.col("__stored"))
        )
        return fresh.select(*source.columns)

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = claim_version(spark, table_root, f"{run}-{batch_id}")
        source = latest_per_key(batch, ["agent_id"], order_by)
        table = BucketedTable(spark, table_root)
        if table.exists():
            # Only the buckets that the batch falls into are read and written.
            described = provision(newer(table.read_touched(source, below=version), source), as_of())
            table.merge(*described, version=version, new_columns=order_by)
            return
        target = read_latest(spark, table_root, below=version)
        if target is None:
            raise RuntimeError(f"no catalogue version under {table_root}")
        for c in order_by:
            if c not in target.columns:
                target = target.withColumn(c, F.lit(None).cast(batch.schema[c].dataType))
        publish(catalog_upsert(target, newer(target, source), as_of()), table_root, version)

    writer = feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return _started(writer, continuous)
