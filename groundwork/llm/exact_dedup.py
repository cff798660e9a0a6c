"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition gives one run: its distinct content keys in order, each with the best
identifier and the number of rows. Runs meet in rounds: in every round ``fan_in`` neighbouring
runs merge into one, sorted by key, keeping the best identifier of each key. A key is SHA-256,
length and a second 64-bit hash of the text, compared in full on every level, so a collision of
one hash never joins two texts. The last round spans all runs and is split by key over tasks. The
answers go back down the same tree, so a text held by a third of all rows meets at most
``fan_in`` rows per join key above the leaves, and one run's rows of it at the leaves.

Only digests travel (about 60 bytes a document and round); texts are read once and not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.registry import query, table
from groundwork.llm.storage import KEY, content_key, identity, stored, without_rows

FAN_IN = 16


def _best(keep: str, of: str):
    return F.max(of) if keep == "largest" else F.min(of)


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", fan_in: int = FAN_IN
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text is the empty text. ``keep`` is "smallest" or
    "largest": of equal texts the row with that identifier stays; a null identifier stays only
    where the text has no other. Of rows repeated with the same identifier and text, exactly one
    stays. Other columns of ``docs`` are not looked at. An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    row = F.monotonically_increasing_id()
    unknown = F.col(id_column).isNull() if keep == "smallest" else F.lit(False)
    leaves = stored(
        docs.select(
            F.col(id_column).alias("doc_id"),
            *content_key(F.col(text_column)),
            F.spark_partition_id().cast("long").alias("run"),
            # Ordered by whether it is missing, the identifier, then the row.
            F.struct(unknown.alias("unknown"), F.col(id_column).alias("id"), row.alias("row")).alias("best"),
        ),
        "digests",
    )
    top = leaves.agg(F.max("run")).first()[0] or 0
    levels = [stored(_merged(leaves.withColumn("n", F.lit(1).cast("long")), ["run", *KEY], keep), "runs")]
    while top >= fan_in:
        top //= fan_in
        above = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in))
        levels.append(stored(_merged(above, ["run", *KEY], keep), "runs"))
    answer = _merged(levels[-1], KEY, keep)
    # Down again: the answer of a run above goes to the runs it was merged from.
    for k, level in enumerate(reversed(levels)):
        own = level.select("run", *KEY)
        if k == 0:
            answer = own.join(answer, KEY)
        else:
            up = answer.withColumnRenamed("run", "above")
            answer = own.withColumn("above", F.floor(F.col("run") / fan_in)).join(up, ["above", *KEY]).drop("above")
    found = leaves.withColumnRenamed("best", "own").join(answer, ["run", *KEY])
    return found.select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("own.row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs``, all columns, with one row for each distinct text: the one :func:`exact_dedup` keeps.

    Of rows repeated with the same identifier and text, whatever their other columns, any one stays.
    An empty table stays empty.
    """
    own = F.struct(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha")).alias("own")
    judged = stored(exact_dedup(docs, id_column, text_column, keep).select(own, "kept"), "kept")
    judged = judged.groupBy("own").agg(F.max("kept").alias("stays"), F.count("*").alias("times"))
    judged = stored(judged.where("times > 1 OR NOT stays"), "judged")
    once = without_rows(docs, judged, id_column, text_column)
    repeated = judged.where("stays")
    if repeated.isEmpty():
        return once
    # Seldom: a row that stays is there several times.
    key = "own"
    while key.lower() in {c.lower() for c in docs.columns}:
        key += "_"
    again = without_rows(docs, repeated, id_column, text_column, "left_semi").withColumn(key, identity(id_column, text_column))
    return once.unionByName(again.dropDuplicates([key]).drop(key))


def _merged(runs: DataFrame, keys: list[str], keep: str) -> DataFrame:
    return runs.groupBy(*keys).agg(_best(keep, "best").alias("best"), F.sum("n").alias("n"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query("op5_exact_dedup", OP5_SQL)
def op5(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dedup(table(spark, directory, "documents"), keep="largest")
