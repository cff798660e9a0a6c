"""Arrow batches in and out of tasks."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from groundwork.llm.words import slices


def schema_with(docs: DataFrame, columns: dict[str, str], more: str) -> T.StructType:
    """The types of columns of ``docs`` under new names, then the fields of the DDL text ``more``."""
    own = [T.StructField(new, docs.schema[old].dataType, True) for new, old in columns.items()]
    return T.StructType([*own, *T.StructType.fromDDL(more).fields]) if more else T.StructType(own)


def map_rows(
    docs: DataFrame, schema: T.StructType, work: Callable[[Iterator[pa.Table]], Iterator[dict]], text: str = "text", most: int = 4 << 20, keeps: str | None = None
) -> DataFrame:
    """Run ``work`` over tables of about ``most`` bytes of text; it yields columns of ``schema`` as a dict.

    ``keeps`` names the :func:`worker_state` that ``work`` uses; what others left in the worker is let go.
    """
    out = to_arrow_schema(schema)

    def tables(batches):
        for batch in batches:
            yield from slices(batch, text, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        for columns in work(tables(batches)):
            arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()]
            yield from pa.Table.from_arrays(
                [a.cast(t) if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(arrays, out.types, strict=True)], schema=out
            ).to_batches()

    return docs.mapInArrow(run, schema)


def forget(but: str | None = None) -> None:
    """Let go of what operators remember in this worker, except one, and give the memory back."""
    module = sys.modules.get("_groundwork_worker")
    names = [name for name in (module.__dict__ if module else ()) if not name.startswith("__") and name != but]
    if names:
        for name in names:
            del module.__dict__[name]
    release()


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker, for models loaded once per process."""
    module = sys.modules.setdefault("_groundwork_worker", types.ModuleType("_groundwork_worker"))
    return module.__dict__.setdefault(name, {})
