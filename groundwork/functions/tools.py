"""Tools that SQL text can call: the scalar score, and table functions over TABLE arguments.

A table function sees one partition of its argument in order and keeps a single row of it, so a partition of
any size costs no memory; rows come sorted by the ORDER BY of the call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from groundwork.functions import similarity


@arrow_udtf(returnType="key string, value string, n_rows bigint")
class DistinctValues:
    """``distinct_values_of(TABLE(SELECT key, value ...) PARTITION BY key ORDER BY value)``: distinct values with their rows.

    Rows come in Arrow batches, of which only the rows that end a run of equal values become Python values.
    """

    def __init__(self):
        self.key = self.value = None
        self.rows = 0

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        done, last = [], -1
        ends = _run_ends(batch.column(1))
        keys, values = (_texts(batch.column(c).take(pa.array(ends, pa.int64()))) for c in (0, 1))
        for key, value, end in zip(keys, values, ends, strict=True):
            if self.rows and value != self.value:
                done.append((self.key, self.value, self.rows))
                self.rows = 0
            self.key, self.value, self.rows, last = key, value, self.rows + end - last, end
        if done:
            yield _distinct(done)

    def terminate(self) -> Iterator[pa.Table]:
        if self.rows:
            yield _distinct([(self.key, self.value, self.rows)])


def _distinct(rows: list[tuple[str | None, str | None, int]]) -> pa.Table:
    return pa.table([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["key", "value", "n_rows"])


def _run_ends(values: pa.Array) -> list[int]:
    """Rows whose successor may be another value, and the last one; where a type has no comparison, all rows."""
    n, kind = len(values), values.type
    if pa.types.is_floating(kind):  # by their bits: -0.0 and 0.0 have different texts, NaN equals nothing
        values = values.view(pa.int64() if kind.bit_width == 64 else pa.int32())
    try:
        changes = pc.fill_null(pc.not_equal(values.slice(0, max(n - 1, 0)), values.slice(1)), True)
    except pa.ArrowNotImplementedError:
        return list(range(n))
    return [*np.flatnonzero(changes.to_numpy(zero_copy_only=False)).tolist(), n - 1] if n else []


def _texts(values: pa.Array) -> list[str | None]:
    return [None if x is None else str(_plain(x, values.type)) for x in values.to_pylist()]


def _plain(x, kind: pa.DataType):
    """A value as Spark's rows hold it: times without a zone, structs as rows."""
    if x is None:
        return None
    if pa.types.is_timestamp(kind) and kind.tz:
        return x.astimezone().replace(tzinfo=None)
    if pa.types.is_struct(kind):
        return Row(**{field.name: _plain(x[field.name], field.type) for field in kind})
    if pa.types.is_list(kind):
        return [_plain(item, kind.value_type) for item in x]
    return x


@udtf(returnType="execution string, n_steps bigint, n_done bigint, answer string", useArrow=True)
class TraceSummary:
    """``trace_summary(TABLE(SELECT execution, step, result ...) PARTITION BY execution ORDER BY step)``: one row per execution."""

    def __init__(self):
        self.execution = self.answer = None
        self.steps = self.done = 0

    def eval(self, row: Row):
        result = row["result"]
        self.execution, self.steps = None if row[0] is None else str(row[0]), self.steps + 1
        self.done += bool(result)
        self.answer = result or None

    def terminate(self):
        if self.steps:
            yield self.execution, self.steps, self.done, self.answer


def register(spark: SparkSession) -> None:
    """Make ``jaro_winkler``, ``distinct_values_of`` and ``trace_summary`` callable from SQL."""
    similarity.register(spark)
    spark.udtf.register("distinct_values_of", DistinctValues)
    spark.udtf.register("trace_summary", TraceSummary)
