"""Exact and approximate vector top-k, dimension checks and neighbour votes.

A corpus is a frame with ``id`` and ``embedding`` (array of float); rows whose embedding is
NULL have no distance and never appear in a result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.errors import DimensionMismatch
from groundwork.functions import vectors as kernels
from groundwork.functions.vectors import COSINE, DOT, METRICS
from groundwork.sources.scratch import checkpointed

# A query set is broadcast up to this many rows and scored block against block beyond it.
MAX_BROADCAST_QUERIES = 4096
# A result of up to this many (query, id, distance) rows may be broadcast.
MAX_BROADCAST_ROWS = 1_000_000
# Rows of one corpus block and of one query block: what one task holds at a time. The corpus is copied once per
# query block and the queries once per corpus block, so equal blocks move the least.
CORPUS_BLOCK = 16384
QUERY_BLOCK = 16384
# Bound on the number of index cells, so that the centres always fit in one task.
MAX_CELLS = 65536
# Rows sampled per cell to fit the centres, at least.
SAMPLE_PER_CELL = 40

FOUND = "query_id bigint, id bigint, distance double"


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")


def _vectors(df: DataFrame, id_name: str = "id") -> DataFrame:
    return df.select(F.col(id_name).cast("bigint").alias("id"), "embedding").where(F.col("embedding").isNotNull())


def _queries(df: DataFrame) -> DataFrame:
    return _vectors(df, "query_id").withColumn("embedding", F.col("embedding").cast("array<double>"))


def _keep_best(found: DataFrame, k: int) -> DataFrame:
    """k best per query; the rank limit also runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_topk(corpus: DataFrame, query: Sequence[float], k: int = 5, metric: str = DOT) -> DataFrame:
    """(id, distance) of the k corpus rows nearest to one query, nearest first."""
    _check_metric(metric)
    point = np.asarray(query, dtype=np.float64)[None, :]
    scan = kernels.scan_topk(np.zeros(1, dtype=np.int64), point, k, metric, skip_self=False)
    best = _vectors(corpus).mapInArrow(scan, FOUND)
    return best.select("id", "distance").orderBy("distance", "id").limit(k)


def vector_topk_batch(
    corpus: DataFrame, queries: DataFrame, k: int = 5, metric: str = DOT, skip_self: bool = False
) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest corpus rows of every query.

    Few queries are sent to every task and the corpus is scanned once without a shuffle.
    More than ``MAX_BROADCAST_QUERIES`` are scored block against block; both ways are exact.
    """
    return topk_batch_sized(corpus, queries, k, metric, skip_self)[0]


def topk_batch_sized(
    corpus: DataFrame, queries: DataFrame, k: int, metric: str, skip_self: bool = False
) -> tuple[DataFrame, bool]:
    """The batch result, and whether it is proven to be small enough to broadcast."""
    _check_metric(metric)
    asked = _queries(queries)
    head = _bounded(asked)
    if head is None:
        cell = F.lit(0).alias("cell")
        blocks = asked.select(F.col("id").alias("query_id"), "embedding", cell)
        return _blocked_topk(_vectors(corpus).select("*", cell), blocks, k, metric, skip_self), False
    ids, points = head
    if len(ids) == 0:
        empty = corpus.sparkSession.createDataFrame([], FOUND)
        return _keep_best(empty, k), True
    found = _vectors(corpus).mapInArrow(kernels.scan_topk(ids, points, k, metric, skip_self), FOUND)
    return _keep_best(found, k), len(ids) * k <= MAX_BROADCAST_ROWS


def _bounded(asked: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of a query set of at most ``MAX_BROADCAST_QUERIES`` rows, else None."""
    head = asked.limit(MAX_BROADCAST_QUERIES + 1).collect()
    if len(head) > MAX_BROADCAST_QUERIES:
        return None
    if len({len(row.embedding) for row in head}) > 1:
        raise DimensionMismatch("the queries differ in their number of components")
    ids = np.array([row.id for row in head], dtype=np.int64)
    return ids, np.array([row.embedding for row in head], dtype=np.float64)


def distinct_hits(found: DataFrame) -> DataFrame:
    """(query_id, id, distance) with one row for an id that several cells hold."""
    return found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))


def checkpointed_queries(df: DataFrame) -> DataFrame:
    """(query_id, embedding) of (id, embedding) rows, computed once."""
    return checkpointed(df.select(F.col("id").alias("query_id"), "embedding"))


def _blocked_topk(
    corpus: DataFrame, queries: DataFrame, k: int, metric: str, skip_self: bool, twice: bool = False
) -> DataFrame:
    """Top-k of (id, embedding, cell) for (query_id, embedding, cell), matched on cell.

    ``twice`` says that an id may lie in several cells.

    Each cell is cut into corpus and query blocks of bounded size and one task meets one pair
    of blocks, so a cell holding a third of all rows only becomes more tasks. A task returns
    k rows per query, not its pairs.
    """
    grid = (
        corpus.groupBy("cell").agg(F.count("*").alias("rows"))
        .join(queries.groupBy("cell").agg(F.count("*").alias("asked")), "cell")
        .select(
            "cell",
            F.ceil(F.col("rows") / CORPUS_BLOCK).cast("int").alias("corpus_blocks"),
            F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("query_blocks"),
        )
    )
    # At most MAX_CELLS rows of three numbers.
    grid = F.broadcast(grid)
    left = corpus.join(grid, "cell").select(
        "id",
        "embedding",
        "cell",
        F.pmod(F.xxhash64("id"), "corpus_blocks").cast("int").alias("corpus_block"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"),
    )
    right = queries.join(grid, "cell").select(
        "query_id",
        "embedding",
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("corpus_blocks") - 1)).alias("corpus_block"),
        F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int").alias("query_block"),
    )
    keys = ["cell", "corpus_block", "query_block"]

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        vectors = asked.column("embedding").combine_chunks()
        dim = vectors.value_lengths()[0].as_py() if len(vectors) else 0
        best = kernels.Nearest(asked.column("query_id").to_numpy(), kernels.matrix(vectors, dim), k, metric, skip_self)
        if rows.num_rows and asked.num_rows:
            best.add(rows.column("id").to_numpy(), kernels.matrix(rows.column("embedding"), dim))
        return best.table()

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND)
    return _keep_best(distinct_hits(found) if twice else found, k)


def build_ivf(
    corpus: DataFrame, path: str, cells: int = 16, seed: int = 42, sample_rows: int = 100_000
) -> str:
    """Write the corpus partitioned by its nearest of ``cells`` centres, and the centres.

    The centres are fitted on a sample of about ``sample_rows`` rows; every row is written. Large cells
    are split over many files, so they are written and read by many tasks.
    """
    if not 1 <= cells <= MAX_CELLS:
        raise ValueError(f"cells must be between 1 and {MAX_CELLS}")
    rows = _vectors(corpus)
    featured = rows.withColumn("features", array_to_vector("embedding"))
    share = min(1.0, max(sample_rows, SAMPLE_PER_CELL * cells) / max(rows.count(), 1))
    training = featured if share >= 1.0 else featured.sample(share, seed=seed)
    model = KMeans(k=cells, seed=seed, featuresCol="features", predictionCol="cell").fit(training)
    placed = model.transform(featured).select("id", "embedding", "cell")
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    corpus.sparkSession.createDataFrame(centers, "cell int, center array<double>").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/centers")
    return path


def ivf_topk(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 5,
    nprobe: int = 12,
    metric: str = DOT,
    skip_self: bool = False,
) -> DataFrame:
    """Approximate top-k: each query meets only its ``nprobe`` best cells, scored exactly there."""
    _check_metric(metric)
    points = _centers(spark, path)
    corpus = spark.read.parquet(f"{path}/cells")
    asked = _queries(queries)
    head = _bounded(asked)
    if head is not None and len(head[0]):
        ids, vectors = head
        cells = kernels.best_cells(vectors, points, nprobe)
        scan = kernels.scan_cells(ids, vectors, cells, k, metric, skip_self)
        probed = _only_cells(corpus, np.unique(cells).tolist(), len(points))
        return _keep_best(probed.select("id", "embedding", "cell").mapInArrow(scan, FOUND), k)
    probes = asked.mapInArrow(
        kernels.probe_cells(points, nprobe), "query_id bigint, embedding array<double>, cell int"
    )
    return _blocked_topk(corpus, probes, k, metric, skip_self)


def probes_for(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 5, target: float = 0.95, metric: str = DOT
) -> int:
    """Smallest ``nprobe`` with which the index finds ``target`` of the exact top k of ``queries``.

    An exact neighbour is found once its cell is probed, so the place of that cell in each
    query's order says how many probes it needs. One exact search measures all settings.
    """
    points = _centers(spark, path)
    corpus = spark.read.parquet(f"{path}/cells")
    near = _small(*topk_batch_sized(corpus, queries, k, metric)).select("query_id", "id")
    placed = (
        corpus.select("id", "cell")
        .join(near, "id")
        .join(_queries(queries).withColumnRenamed("id", "query_id"), "query_id")
        .select("embedding", "cell")
        .mapInArrow(kernels.cell_positions(points), "place int")
    )
    # One row per cell at most.
    counts = {row["place"]: row["count"] for row in placed.groupBy("place").count().collect()}
    wanted, found = target * sum(counts.values()), 0
    for place in sorted(counts):
        found += counts[place]
        if found >= wanted:
            return place
    return len(points)


def _centers(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centers").orderBy("cell").limit(MAX_CELLS).collect()
    return np.array([row.center for row in rows])


def _only_cells(corpus: DataFrame, cells: list[int], total: int) -> DataFrame:
    """At most one literal per cell; they prune the partition directories."""
    return corpus if len(cells) == total else corpus.where(F.col("cell").isin(cells))


def _small(near: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(near) if bounded else near


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_exact, n_found, recall) of one top-k result against another."""
    hits = exact.select("query_id", "id").join(
        approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left"
    )
    return hits.agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found")).withColumn(
        "recall", F.round(F.try_divide("n_found", "n_exact"), 4)
    )


def check_dims(df: DataFrame, column: str, dim: int) -> DataFrame:
    """The same frame; reading a vector of another size raises."""
    size = F.size(column)
    complaint = F.concat(F.lit(f"expected {dim} components, found "), size.cast("string"))
    checked = F.when(F.col(column).isNull() | (size == dim), F.col(column)).otherwise(F.raise_error(complaint))
    return df.withColumn(column, checked)


def dim_report(df: DataFrame, column: str, dim: int) -> DataFrame:
    """(dims, n_rows, fits): how many vectors there are of each size; 0 is a missing one."""
    size = F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.size(column)).cast("bigint")
    counts = df.groupBy(size.alias("dims")).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("fits", F.col("dims") == dim)


def dim_offenders(df: DataFrame, key: str, column: str, dim: int) -> DataFrame:
    """(key, dims) of the rows whose vector is missing or of another size."""
    size = F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.size(column))
    return df.select(key, size.cast("bigint").alias("dims")).where(F.col("dims") != dim)


def knn_label_vote(live: DataFrame, history: DataFrame, k: int = 5, metric: str = DOT) -> DataFrame:
    """(query_id, label, votes): most frequent label among the k nearest labelled rows.

    Equal counts go to the label with the nearer sum of distances, then the smaller label.
    """
    near = _small(*topk_batch_sized(history, live, k, metric))
    votes = (
        history.select("id", "label").join(near, "id")
        .groupBy("query_id", "label")
        .agg(F.count("*").alias("votes"), F.round(F.sum("distance"), 6).alias("spread"))
    )
    best = F.min(F.struct((-F.col("votes")).alias("order"), "spread", "label", "votes")).alias("best")
    return votes.groupBy("query_id").agg(best).select("query_id", "best.label", "best.votes")


def rul_estimate(live: DataFrame, history: DataFrame, k: int = 5, metric: str = DOT) -> DataFrame:
    """(query_id, remaining): mean life of the k nearest histories, nearer ones weigh more.

    The weight is 1 / (1 + distance beyond the nearest one's): 1 for the nearest, whatever the
    length of the vectors, falling as they get farther.
    """
    near = _small(*topk_batch_sized(history, live, k, metric))
    least = F.min("distance").over(Window.partitionBy("query_id"))  # k rows each
    weighted = history.select("id", "life").join(near.withColumn("beyond", F.col("distance") - least), "id").withColumn(
        "weight", 1 / (1 + F.col("beyond"))
    )
    total = F.sum(F.col("weight") * F.col("life")) / F.sum("weight")
    return weighted.groupBy("query_id").agg(F.round(total, 4).alias("remaining"), F.count("*").alias("neighbours"))


__all__ = [
    "COSINE",
    "DOT",
    "build_ivf",
    "check_dims",
    "dim_offenders",
    "dim_report",
    "ivf_topk",
    "knn_label_vote",
    "probes_for",
    "recall",
    "rul_estimate",
    "topk_batch_sized",
    "vector_topk",
    "vector_topk_batch",
]
