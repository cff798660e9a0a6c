"""Shards of near-equal bytes by best-fit-decreasing packing of indivisible groups.

Rows with equal texts form a group that no shard boundary cuts. Packing is sequential by nature,
so what reaches it is bounded by the number of shards, not by the data: a group above 1/1024 of a
shard is packed by itself (there are at most 1024 of them per shard), the small ones are first
summed into 512 bundles per shard by the hash of their key. Sizes, bundles, assignment and slots
are Spark jobs; the driver sees at most 1536 sizes per shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.llm.bins import best_fit_decreasing, best_fit_into
from groundwork.llm.registry import query, table
from groundwork.llm.storage import KEY, content_key, partitions, stored

LARGE, BUNDLES = 1024, 512


def shard_documents(
    docs: DataFrame, shards: int | None = 8, capacity: int | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    Size is the UTF-8 bytes of the text plus 1; a null text is empty. Rows with equal texts share a
    shard. With ``shards``, that many shards of near-equal bytes: they differ by about one bundle
    (1/512 of a shard) unless one group is larger than a fair share, which then has a shard alone.
    With ``capacity`` instead, as few shards of that many bytes as best fit finds; a larger group
    has one to itself. ``slot`` counts the rows of a shard from 0 without gaps, by the hash cell of
    the row, then by doc_id; nulls come first, and repeated rows get slots of their own. An empty
    table gives no rows. Other columns are not looked at.
    """
    if (shards is None) == (capacity is None) or (shards or capacity) < 1:
        raise ValueError("give either shards or capacity, at least 1")
    rows = stored(
        docs.select(
            F.col(id_column).alias("doc_id"),
            *content_key(F.col(text_column)),
            F.crc32(F.coalesce(F.col(text_column), F.lit("")).cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("size", F.col("bytes") + 1),
        "sizes",
    )
    groups = stored(rows.groupBy(*KEY).agg(F.sum("size").alias("total")), "groups")
    whole = groups.agg(F.sum("total")).first()[0] or 0
    wanted = shards or max(1, -(-whole // capacity))
    large = F.col("total") * (wanted * LARGE) > whole
    bundle = F.pmod(F.xxhash64("sha"), F.lit(wanted * BUNDLES))
    alone = groups.where(large).orderBy(*KEY).collect()
    sums = groups.where(~large).groupBy(bundle.alias("bundle")).agg(F.sum("total").alias("total")).orderBy("bundle").collect()
    sizes = [r["total"] for r in alone] + [r["total"] for r in sums]
    chosen = best_fit_into(sizes, shards) if shards else best_fit_decreasing(sizes, capacity)
    spark = docs.sparkSession
    by_key = spark.createDataFrame(
        [(bytes(r["sha"]), r["bytes"], r["check"], s) for r, s in zip(alone, chosen, strict=False)],
        "sha binary, bytes long, check long, own int",
    )
    by_bundle = spark.createDataFrame(
        [(r["bundle"], s) for r, s in zip(sums, chosen[len(alone) :], strict=True)], "bundle long, shared int"
    )
    placed = (
        rows.join(F.broadcast(by_key), KEY, "left")
        .withColumn("bundle", bundle)
        .join(F.broadcast(by_bundle), "bundle", "left")
        .withColumn("shard", F.coalesce("own", "shared"))
        .withColumn("cell", F.pmod(F.xxhash64("doc_id", "row"), F.lit(partitions(docs))))
        .select("doc_id", "size", "text_crc32", "shard", "cell", "row")
    )
    # Slots start where the cells before end: a window over counts, then one inside each cell.
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "row")
    numbered = placed.withColumn("rank", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot")
    )


@query("op10_sharding")
def op10(spark: SparkSession, directory: str) -> DataFrame:
    out = shard_documents(table(spark, directory, "documents"), shards=8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
