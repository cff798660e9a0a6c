"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundwork.llm.decontamination import without_contaminated
from groundwork.llm.exact_dedup import without_copies
from groundwork.llm.jaccard_join import without_near_copies
from groundwork.llm.packing import digest, pack_documents
from groundwork.llm.registry import table
from groundwork.llm.storage import made, remove, stored
from groundwork.llm.toxicity import fit, without_toxic


#: Intermediate tables of the stage called last.
_LAST: list[str] = []


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose intermediate tables go when the next stage begins: by then its result is written."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, [path for path in _LAST if path in made()])
        before = set(made())
        result = work(spark, docs, sf_dir)
        _LAST[:] = [path for path in made() if path not in before]
        return result

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return without_copies(docs, keep="largest")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by 75 % similarity the smallest doc_id stays."""
    return without_near_copies(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2,048 along the curve; one row per piece."""
    return digest(pack_documents(docs))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Training, similarity and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stored(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
