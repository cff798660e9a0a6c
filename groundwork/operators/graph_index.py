"""Neighbour-graph index: one navigable graph per shard of the corpus, built and searched in tasks.

A shard holds a bounded number of vectors, whatever the size of the corpus, so an index has as many shards
as it needs and a task builds or searches one at a time. In a shard every vector is linked to near ones that
lie in different directions (a candidate much closer to a chosen link than to the vector itself is
superfluous), and back. A search walks from a few far-apart entry vectors, always expanding the nearest
vector not yet expanded, until the ``width`` nearest ones found are all expanded. The best of every shard are
merged. The written index is searched by any later session.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.errors import DimensionMismatch
from groundwork.functions import vectors as kernels
from groundwork.functions.vectors import COSINE, DOT
from groundwork.operators import vectors as search

#: Links a vector chooses, the candidates it chooses them from, and links back that it accepts.
LINKS, CANDIDATES, BACK = 24, 96, 48
#: A candidate is superfluous when it is this much closer (squared) to a chosen link than to the vector.
SPREAD = 1.2
#: Vectors of one shard, entry vectors of its graph, and vectors that a search keeps in sight.
SHARD_ROWS, ENTRIES, WIDTH = 4096, 4, 128
#: Vectors of a shard that choose their links at a time.
STRIP = 128

SHARD = "shard bigint, metric string, dim int, ids binary, vectors binary, starts binary, links binary, entries array<int>"


def build_graph(corpus: DataFrame, folder: str, metric: str = DOT, shard_rows: int = SHARD_ROWS) -> GraphIndex:
    """Write the graphs of all (id, embedding) rows to ``folder``; what is there already is replaced."""
    search._check_metric(metric)
    rows = search._vectors(corpus)
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)))

    def build(group: pa.Table) -> pa.Table:
        lists = group.column("embedding").combine_chunks()
        dim = lists.value_lengths()[0].as_py()
        vectors = kernels.matrix(lists, dim)
        starts, links, entries = graph_of(vectors, metric)
        row = {
            "shard": group.column("shard")[0].as_py(),
            "metric": metric,
            "dim": dim,
            "ids": group.column("id").to_numpy().astype(np.int64).tobytes(),
            "vectors": vectors.astype(np.float32).tobytes(),
            "starts": starts.tobytes(),
            "links": links.tobytes(),
            "entries": entries,
        }
        return pa.Table.from_pylist([row], schema=_arrow())

    dealt.groupBy("shard").applyInArrow(build, SHARD).write.mode("overwrite").parquet(folder)
    return GraphIndex(corpus.sparkSession, folder)


def _arrow() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in SHARD.split(", "))])


def graph_of(vectors: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(starts, links, entries): vector v is linked to ``links[starts[v]:starts[v + 1]]``; all are reached from the entries."""
    points = _in_space(vectors, metric).astype(np.float32)
    n = len(points)
    norms = (points * points).sum(axis=1)
    most = min(CANDIDATES, n - 1)
    if most < 1:
        return np.array([0, 0], np.int32), np.empty(0, np.int32), [0]
    chosen, count = np.full((n, LINKS), -1), np.zeros(n, int)
    for start in range(0, n, STRIP):
        rows = np.arange(start, min(start + STRIP, n))
        chosen[rows], count[rows] = _choose(points, norms, rows, most)
    sets = [set(chosen[v, : count[v]].tolist()) for v in range(n)]
    back = [[] for _ in range(n)]
    for v in range(n):
        for other in sets[v]:
            back[other].append(v)
    for v in range(n):
        extra = np.array(sorted(set(back[v]) - sets[v]), int)
        if len(extra) > BACK:
            extra = extra[np.argsort(_gaps(points, norms, v, extra), kind="stable")[:BACK]]
        sets[v].update(extra.tolist())
    entries = _entries(points)
    _connect(sets, points, norms, entries)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return starts, np.array([other for s in sets for other in sorted(s)], np.int32), entries


def _gaps(points: np.ndarray, norms: np.ndarray, rows, others) -> np.ndarray:
    """Squared distances of some points, or one, to others."""
    return np.maximum(norms[rows][..., None] - 2 * points[rows] @ points[others].T + norms[others], 0)


def _choose(points: np.ndarray, norms: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(chosen, count): the links of some rows, from the ``most`` nearest of all points."""
    gaps, at = _gaps(points, norms, rows, slice(None)), np.arange(len(rows))
    gaps[at, rows] = np.inf
    near = np.argpartition(gaps, most - 1, axis=1)[:, :most]
    gaps = np.take_along_axis(gaps, near, axis=1)
    order = np.argsort(gaps, axis=1, kind="stable")
    near, gaps = np.take_along_axis(near, order, axis=1), np.take_along_axis(gaps, order, axis=1)
    held, size = points[near], norms[near]
    among = np.maximum(size[:, :, None] - 2 * held @ held.transpose(0, 2, 1) + size[:, None, :], 0)
    # Distance of each candidate to the nearest link chosen so far.
    to_chosen = np.full(near.shape, np.inf, np.float32)
    chosen, count = np.full((len(rows), LINKS), -1), np.zeros(len(rows), int)
    for place in range(most):
        take = np.flatnonzero((count < LINKS) & (to_chosen[:, place] * SPREAD >= gaps[:, place]))
        chosen[take, count[take]] = near[take, place]
        count[take] += 1
        to_chosen[take] = np.minimum(to_chosen[take], among[take, place])
    return chosen, count


def _in_space(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Points whose Euclidean neighbours are the metric's: unit vectors for the cosine, one more
    coordinate that makes all equally long for the inner product."""
    norms = np.linalg.norm(vectors, axis=1)
    if metric == COSINE:
        return vectors / np.where(norms > 0, norms, 1)[:, None]
    longest = norms.max(initial=0)
    return np.column_stack([vectors, np.sqrt(np.maximum(longest * longest - norms * norms, 0))])


def _entries(points: np.ndarray) -> list[int]:
    """The vector nearest to the mean, then each time the one farthest from all taken."""
    gap = ((points - points.mean(axis=0)) ** 2).sum(axis=1)
    taken = [int(gap.argmin())]
    least = ((points - points[taken[0]]) ** 2).sum(axis=1)
    while len(taken) < min(ENTRIES, len(points)):
        taken.append(int(least.argmax()))
        least = np.minimum(least, ((points - points[taken[-1]]) ** 2).sum(axis=1))
    return list(dict.fromkeys(taken))


def _connect(sets: list[set[int]], points: np.ndarray, norms: np.ndarray, entries: list[int]) -> None:
    """Link what the entries do not reach, in both directions, at the shortest gap."""
    reached = np.zeros(len(sets), bool)
    stack = list(entries)
    while True:
        reached[stack] = True
        while stack:
            v = stack.pop()
            new = [other for other in sets[v] if not reached[other]]
            reached[new] = True
            stack.extend(new)
        missing = np.flatnonzero(~reached)
        if not len(missing):
            return
        there = np.flatnonzero(reached)
        part = _gaps(points, norms, missing[0], there)
        bridge = int(there[part.argmin()])
        sets[bridge].add(int(missing[0]))
        sets[missing[0]].add(bridge)
        stack = [int(missing[0])]


@dataclass(frozen=True)
class GraphIndex:
    """An index in ``folder``, which every executor can reach."""

    spark: SparkSession
    folder: str

    def search(self, queries: DataFrame, k: int = 5, width: int = WIDTH, skip_self: bool = False) -> DataFrame:
        """(query_id, id, distance, rank): about the top k of each query, by the metric of the index; more ``width`` finds more.

        Up to ``MAX_BROADCAST_QUERIES`` queries go to every task; more meet the shards in blocks.
        """
        stored = self.spark.read.schema(SHARD).parquet(self.folder)
        asked = search._queries(queries)
        head = search._bounded(asked)
        if head is not None:
            return search._keep_best(stored.mapInArrow(_searcher(*head, k, width, skip_self), search.FOUND), k)
        blocks = -(-asked.count() // search.QUERY_BLOCK)
        shards = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        # Shards are numbered from 0; some may be empty.
        last = stored.agg(F.max("shard")).first()[0] or 0
        points = asked.select(
            F.col("id").alias("query_id"),
            "embedding",
            F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))).alias("shard"),
        )

        def meet(shard: pa.Table, held: pa.Table) -> pa.Table:
            none = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
            if not shard.num_rows or not held.num_rows:
                return none
            ids = held.column("query_id").to_numpy()
            vectors = kernels.matrix(held.column("embedding"), shard.column("dim")[0].as_py())
            run = _searcher(ids, vectors, k, width, skip_self)
            return pa.Table.from_batches(list(run(iter(shard.to_batches()))), none.schema)

        keys = ["shard", "block"]
        return search._keep_best(shards.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInArrow(meet, search.FOUND), k)


def _searcher(query_ids: np.ndarray, queries: np.ndarray, k: int, width: int, skip_self: bool):
    """mapInArrow function over shards: each returns its k best per query."""
    width = max(width, k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = batch.slice(row, 1).to_pylist()[0]
                best = kernels.Nearest(query_ids, queries, k, shard["metric"], skip_self)
                vectors = np.frombuffer(shard["vectors"], np.float32).reshape(-1, shard["dim"])
                ids = np.frombuffer(shard["ids"], np.int64)
                if len(queries) and queries.shape[1] != shard["dim"]:
                    raise DimensionMismatch(f"expected {shard['dim']} components, found {queries.shape[1]}")
                walk = _Walk(vectors, shard)
                for number, query in enumerate(queries):
                    found = walk.near(query, width)
                    best.add(ids[found], vectors[found].astype(np.float64), np.array([number]))
                yield from best.table().to_batches()

    return run


class _Walk:
    def __init__(self, vectors: np.ndarray, shard: dict):
        self.starts = np.frombuffer(shard["starts"], np.int32)
        self.links = np.frombuffer(shard["links"], np.int32)
        self.entries = np.array(shard["entries"])
        norms = np.linalg.norm(vectors, axis=1)
        self.vectors = vectors / np.where(norms > 0, norms, 1)[:, None] if shard["metric"] == COSINE else vectors

    def near(self, query: np.ndarray, width: int) -> np.ndarray:
        """Rows of the ``width`` nearest vectors found."""
        point = query.astype(np.float32)
        seen = np.zeros(len(self.vectors), bool)
        seen[self.entries] = True
        gaps = -(self.vectors[self.entries] @ point)
        ahead = [(float(g), int(v)) for g, v in zip(gaps, self.entries, strict=True)]
        kept = [(-g, v) for g, v in ahead]
        heapq.heapify(ahead)
        heapq.heapify(kept)
        while ahead:
            gap, v = heapq.heappop(ahead)
            if len(kept) >= width and gap > -kept[0][0]:
                break
            links = self.links[self.starts[v] : self.starts[v + 1]]
            links = links[~seen[links]]
            if not len(links):
                continue
            seen[links] = True
            gaps = -(self.vectors[links] @ point)
            if len(kept) >= width:
                closer = gaps < -kept[0][0]
                links, gaps = links[closer], gaps[closer]
            for gap, other in zip(gaps.tolist(), links.tolist(), strict=True):
                if len(kept) < width:
                    heapq.heappush(kept, (-gap, other))
                elif gap < -kept[0][0]:
                    heapq.heapreplace(kept, (-gap, other))
                else:
                    continue
                heapq.heappush(ahead, (gap, other))
        return np.array([v for _, v in kept])
