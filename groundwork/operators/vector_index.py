"""A cell index that outlives the query: built once into a named folder, searched and added to later.

    <folder>/centers      one row per cell
    <folder>/settings     what the index was built and calibrated with, one row per calibration
    <folder>/rows/part=N  the vectors, partitioned by cell; one part per build or append

A part becomes visible as a whole, through Spark's ``_SUCCESS`` marker, so a failed append leaves no trace.
A vector whose second-best centre is nearly as close as its best lies in both cells; a search
returns it once. The number of cells to probe is set on held-out rows of the corpus: rows that took
no part in fitting the centres, looked for as queries that must find their exact neighbours.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.errors import TableNotFound
from groundwork.functions import vectors as kernels
from groundwork.functions.vectors import DOT
from groundwork.operators import vectors as search
from groundwork.sources.scratch import list_names

#: One row in this many is held out from fitting; of these so many at most are calibration queries.
HOLD_OUT, CALIBRATION_ROWS = 10, 512
#: Rows sampled to fit the centres, at most, unless the cells need more.
SAMPLE_ROWS = 100_000
#: A second centre within this share of the squared distance to the first also gets the vector.
OVERLAP = 0.02

SETTINGS = "made_at timestamp, k int, target double, nprobe int, metric string"


@dataclass(frozen=True)
class VectorIndex:
    """An index in ``folder``, which every executor can reach."""

    spark: SparkSession
    folder: str

    def exists(self) -> bool:
        return bool(list_names(self.spark, f"{self.folder}/centers/_SUCCESS")) and bool(self._parts())

    def _parts(self) -> list[str]:
        return [f"{self.folder}/rows/{p}" for p in list_names(self.spark, f"{self.folder}/rows/part=*") if list_names(self.spark, f"{self.folder}/rows/{p}/_SUCCESS")]

    def centers(self) -> np.ndarray:
        if not self.exists():
            raise TableNotFound(f"no index in {self.folder}")
        return search._centers(self.spark, self.folder)

    def rows(self) -> DataFrame:
        """(id, embedding, cell, part) of all complete parts; a boundary vector is there twice."""
        parts = self._parts()
        if not parts:
            raise TableNotFound(f"no index in {self.folder}")
        stored = self.spark.read.option("basePath", f"{self.folder}/rows").parquet(*parts)
        return stored.select("id", "embedding", F.col("cell").cast("int").alias("cell"), "part")

    def append(self, corpus: DataFrame, overlap: float = OVERLAP) -> None:
        """Add (id, embedding) rows as a new part; the centres stay as they are."""
        self._write(corpus, search._centers(self.spark, self.folder), overlap)

    def _write(self, corpus: DataFrame, points: np.ndarray, overlap: float) -> None:
        number = len(list_names(self.spark, f"{self.folder}/rows/part=*"))
        placed = search._vectors(corpus).mapInArrow(_place(points, overlap), "id bigint, embedding array<float>, cell int")
        path = f"{self.folder}/rows/part={number:06d}-{uuid.uuid4().hex[:8]}"
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)

    def calibrate(self, k: int = 5, target: float = 0.95, metric: str = DOT) -> int:
        """Number of cells in which held-out rows find ``target`` of their exact ``k`` neighbours; stored.

        The queries are the held-out rows with the smallest hashes, at most ``CALIBRATION_ROWS``. One
        exact search over the whole corpus says what they must find.
        """
        points = self.centers()
        corpus = self.rows()
        once = corpus.select("id", "embedding").dropDuplicates(["id"])
        asked = once.where(_held_out()).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION_ROWS)
        asked = search.checkpointed_queries(asked)
        near = search.vector_topk_batch(once, asked, k, metric, skip_self=True).select("query_id", "id")
        held = corpus.select("id", "cell").join(F.broadcast(near), "id").groupBy("query_id", "id").agg(F.collect_list("cell").alias("cells"))
        placed = held.join(F.broadcast(asked), "query_id").select("embedding", "cells").mapInArrow(_first_place(points), "place int")
        # One row per cell at most.
        counts = {r["place"]: r["count"] for r in placed.groupBy("place").count().collect()}
        wanted, found, nprobe = target * sum(counts.values()), 0, len(points)
        for place in sorted(counts):
            found += counts[place]
            if found >= wanted:
                nprobe = place
                break
        row = self.spark.range(1).select(
            F.current_timestamp().alias("made_at"), F.lit(k).alias("k"), F.lit(float(target)).alias("target"), F.lit(int(nprobe)).alias("nprobe"), F.lit(metric).alias("metric")
        )
        row.write.mode("append").parquet(f"{self.folder}/settings")
        return nprobe

    def nprobe(self, metric: str = DOT) -> int | None:
        """Newest calibrated number of cells for a metric."""
        if not list_names(self.spark, f"{self.folder}/settings/_SUCCESS"):
            return None
        row = self.spark.read.schema(SETTINGS).parquet(f"{self.folder}/settings").where(F.col("metric") == metric)
        found = row.orderBy(F.col("made_at").desc()).select("nprobe").first()
        return None if found is None else found["nprobe"]

    def search(self, queries: DataFrame, k: int = 5, nprobe: int | None = None, metric: str = DOT, skip_self: bool = False) -> DataFrame:
        """(query_id, id, distance, rank): top k of each query in its ``nprobe`` best cells, the calibrated number by default.

        Only the directories of probed cells are read. With all cells the result is exact.
        """
        search._check_metric(metric)
        points = self.centers()
        wanted = nprobe or self.nprobe(metric) or len(points)
        corpus, asked = self.rows(), search._queries(queries)
        head = search._bounded(asked)
        if head is None:
            probes = asked.mapInArrow(kernels.probe_cells(points, wanted), "query_id bigint, embedding array<double>, cell int")
            found = search._blocked_topk(corpus.select("id", "embedding", "cell"), probes, k, metric, skip_self, twice=True)
            return found
        ids, vectors = head
        if not len(ids):
            return search._keep_best(self.spark.createDataFrame([], search.FOUND), k)
        cells = kernels.best_cells(vectors, points, wanted)
        scan = kernels.scan_cells(ids, vectors, cells, k, metric, skip_self)
        probed = search._only_cells(corpus, np.unique(cells).tolist(), len(points))
        found = probed.select("id", "embedding", "cell").mapInArrow(scan, search.FOUND)
        return search._keep_best(search.distinct_hits(found), k)


def build(corpus: DataFrame, folder: str, cells: int = 16, seed: int = 42, sample_rows: int = SAMPLE_ROWS, overlap: float = OVERLAP) -> VectorIndex:
    """Fit ``cells`` centres on a sample that leaves the held-out rows aside, and write every row of (id, embedding).

    A folder that holds a complete index already is refused: append to it.
    """
    if not 2 <= cells <= search.MAX_CELLS:
        raise ValueError(f"cells must be between 2 and {search.MAX_CELLS}")
    spark = corpus.sparkSession
    index = VectorIndex(spark, folder)
    if index.exists():
        raise ValueError(f"{folder} holds an index; append to it")
    rows = search._vectors(corpus)
    training = rows.where(~_held_out()).withColumn("features", array_to_vector("embedding"))
    n = training.count()
    if n < cells:  # a corpus this small is fitted whole
        training = rows.withColumn("features", array_to_vector("embedding"))
        n = training.count()
    if n == 0:
        raise ValueError("an index needs at least one vector")
    share = min(1.0, max(sample_rows, search.SAMPLE_PER_CELL * cells) / n)
    model = KMeans(k=cells, seed=seed, featuresCol="features", predictionCol="cell").fit(training if share >= 1.0 else training.sample(share, seed=seed))
    points = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    spark.createDataFrame(points, "cell int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centers")
    index._write(corpus, np.array([c for _, c in points]), overlap)
    return index


def _held_out():
    return F.pmod(F.xxhash64("id"), F.lit(HOLD_OUT)) == 0


def _place(points: np.ndarray, overlap: float):
    """mapInArrow function: each (id, embedding) with its nearest cell, and its second where that is nearly as near."""
    norms = (points * points).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.few_rows(batches, len(points)):
            rows = kernels.matrix(batch.column(1), points.shape[1])
            gaps = np.maximum((rows * rows).sum(axis=1)[:, None] - 2 * rows @ points.T + norms, 0)
            order = np.argsort(gaps, axis=1, kind="stable")[:, :2]
            at, cells = np.arange(len(rows)), order[:, 0]
            if points.shape[0] > 1:
                both = np.flatnonzero(gaps[at, order[:, 1]] <= (1 + overlap) * gaps[at, order[:, 0]])
                at, cells = np.concatenate([at, both]), np.concatenate([cells, order[both, 1]])
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cells, pa.int32())], names=["id", "embedding", "cell"])

    return run


def _first_place(points: np.ndarray):
    """mapInArrow function over (embedding, cells): the best place any of the cells has in the vector's order, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.few_rows(batches, len(points)):
            order = kernels.best_cells(kernels.matrix(batch.column(0), points.shape[1]), points, len(points))
            places = np.empty_like(order)
            np.put_along_axis(places, order, np.broadcast_to(np.arange(1, len(points) + 1), order.shape), axis=1)
            best = [int(places[i, cells].min()) for i, cells in enumerate(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32())], names=["place"])

    return run
