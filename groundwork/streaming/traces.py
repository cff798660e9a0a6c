"""Live state of running executions, by arbitrary state per execution.

An execution is idle until its first step, processing while its last step has no result, completed once it
has one, and error as soon as any step failed. What is kept per execution (counts and the highest step)
does not depend on the order in which steps arrive, so the live state equals the batch one for any batching.
With ``stalled_after`` an event-time timer reports executions that stay in processing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from groundwork.sources.scratch import list_names

IDLE, PROCESSING, COMPLETED, ERROR, STALLED = "idle", "processing", "completed", "error", "stalled"

STATE = "n_steps bigint, n_done bigint, failed boolean, last_step bigint, answer string, last_at_ms bigint"
TRACE = "execution_id string, state string, n_steps bigint, n_done bigint, last_step bigint, answer string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_of(failed, has_answer, n_steps):
    """The state of a summary, for batch frames."""
    return (
        F.when(n_steps == 0, IDLE).when(failed, ERROR).when(has_answer, COMPLETED).otherwise(PROCESSING)
    )


def batch_traces(steps: DataFrame) -> DataFrame:
    """The same rows as the live trace of all of ``steps`` (execution_id, step, at, result, failed)."""
    done = F.coalesce(F.col("result") != "", F.lit(False))
    summed = steps.groupBy(F.col("execution_id").cast("string").alias("execution_id")).agg(
        F.count("*").alias("n_steps"),
        F.count_if(done).alias("n_done"),
        F.coalesce(F.bool_or("failed"), F.lit(False)).alias("failed"),
        F.max(F.struct(F.col("step"), F.when(done, F.col("result")).alias("result"))).alias("last"),
    )
    return summed.select(
        "execution_id",
        state_of(F.col("failed"), F.col("last.result").isNotNull(), F.col("n_steps")).alias("state"),
        "n_steps",
        "n_done",
        F.col("last.step").alias("last_step"),
        F.col("last.result").alias("answer"),
    )


class _Trace(StatefulProcessor):
    def __init__(self, stalled_after_ms: int | None):
        self.stalled_after_ms = stalled_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("trace", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, done, failed, last, answer, at = self.kept.get() if self.kept.exists() else (0, 0, False, None, None, 0)
        for batch in rows:
            for step, moment, result, bad in zip(batch["step"], batch["at_ms"], batch["result"], batch["failed"], strict=True):
                has = isinstance(result, str) and result != ""
                n, done, failed = n + 1, done + has, failed or bool(bad)
                mine = result if has else None
                # Of one step number the greater result counts, whichever came first.
                if last is None or step > last or (step == last and (mine or "") > (answer or "")):
                    last, answer = int(step), mine
                at = max(at, int(moment))
        self.kept.update((n, done, failed, last, answer, at))
        state = _named(failed, answer)
        if self.stalled_after_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state == PROCESSING:
                self.handle.registerTimer(at + self.stalled_after_ms)
        yield _row(key, state, n, done, last, answer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            n, done, failed, last, answer, _ = self.kept.get()
            if _named(failed, answer) == PROCESSING:
                yield _row(key, STALLED, n, done, last, answer)

    def close(self) -> None:
        pass


def _named(failed: bool, answer: str | None) -> str:
    return ERROR if failed else COMPLETED if answer is not None else PROCESSING


def _row(key, state, n, done, last, answer) -> pd.DataFrame:
    return pd.DataFrame({"execution_id": [key[0]], "state": [state], "n_steps": [n], "n_done": [done], "last_step": [last], "answer": [answer]})


def stream_traces(
    steps: DataFrame, out_dir: str, checkpoint: str, stalled_after: float | None = None, late: str = "10 minutes", continuous: str | None = None
) -> StreamingQuery:
    """Follow a stream of steps (execution_id, step, at, result, failed); every batch writes the executions it changed.

    ``at`` is the event time. ``stalled_after`` seconds without a step, by the watermark, make a processing
    execution stalled until its next step; only then does ``late`` bound how late a step may come. A replayed
    batch replaces its directory. :func:`read_traces` gives the newest state of each.
    """
    spark = steps.sparkSession
    timed = steps.withColumn("at", F.col("at").cast("timestamp"))
    if stalled_after is not None:
        timed = timed.withWatermark("at", late)
    rows = timed.select(
        F.col("execution_id").cast("string").alias("execution_id"),
        F.col("step").cast("bigint").alias("step"),
        F.unix_millis("at").alias("at_ms"),
        F.col("result").cast("string").alias("result"),
        F.coalesce(F.col("failed"), F.lit(False)).alias("failed"),
        *(["at"] if stalled_after is not None else []),
    )
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    after = None if stalled_after is None else int(stalled_after * 1000)
    live = rows.groupBy("execution_id").transformWithStateInPandas(
        _Trace(after), outputStructType=TRACE, outputMode="Update", timeMode="None" if after is None else "EventTime"
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id:012d}")

    writer = live.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if continuous is None else writer.trigger(processingTime=continuous)).start()


def read_traces(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest state of every execution; what a batch said last counts, a timer after the batch's steps."""
    if not list_names(spark, f"{out_dir}/batch_id=*"):
        return spark.createDataFrame([], TRACE)
    told = spark.read.schema(TRACE + ", batch_id bigint").parquet(out_dir)
    names = [c for c in told.columns if c != "batch_id"]
    newest = F.max_by(F.struct(*names), F.struct("batch_id", (F.col("state") == STALLED).alias("timer")))
    return told.groupBy("execution_id").agg(newest.alias("row")).select("row.*")
