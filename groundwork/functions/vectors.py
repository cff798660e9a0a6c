"""Arrow kernels for vector distances.

Distances are "smaller is nearer": the negated inner product for ``dot`` and one minus the
cosine for ``cosine``. They are rounded to 1e-9 before ranking, so equal vectors tie whatever
the order of summation, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from groundwork.errors import DimensionMismatch

DOT = "dot"
COSINE = "cosine"
METRICS = (DOT, COSINE)
RANK_DIGITS = 9

# Scores held at once by one task: so many rows of a batch times so many queries.
ROW_STRIP, QUERY_STRIP = 4096, 256
# Gaps to centres held at once by one task, whatever the number of cells: about 16 MB.
CELL_GAPS = 1 << 21


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without NULLs as a (rows, dim) float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and not (sizes == dim).all():
        raise DimensionMismatch(f"expected {dim} components, found {sorted(set(sizes.tolist()))}")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def distances(corpus: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """(corpus rows, queries) distances; NaN where a cosine has a zero norm."""
    product = corpus @ queries.T
    if metric == COSINE:
        norms = np.linalg.norm(corpus, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            product = 1 - product / norms
        product[~np.isfinite(product)] = np.nan
        return np.round(product, RANK_DIGITS) + 0.0
    return np.round(-product, RANK_DIGITS) + 0.0


def nearest(ids: np.ndarray, column: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k smallest distances, ties by id."""
    rows = np.arange(len(column))
    if len(rows) > k:
        kth = np.partition(column, k - 1)[k - 1]
        rows = np.flatnonzero(column <= kth)
    return rows[np.lexsort((ids[rows], column[rows]))][:k]


class Nearest:
    """The k nearest rows of each query among all rows shown to it so far.

    What a task keeps is queries x k entries, however many rows it reads; rows farther than a
    query's k-th best are dropped by one comparison.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str, skip_self: bool, distinct: bool = False):
        # ``distinct``: an id may be shown several times, in different blocks, and is kept once.
        self.query_ids, self.queries, self.distinct = query_ids, queries, distinct
        self.k, self.metric, self.skip_self = k, metric, skip_self
        self.limit = np.full(len(queries), np.inf)
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, ids: np.ndarray, corpus: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Show a block of rows to all queries, or to those numbered ``asking``."""
        asking = np.arange(len(self.queries)) if asking is None else asking
        if len(ids) > ROW_STRIP:
            for start in range(0, len(ids), ROW_STRIP):
                self.add(ids[start : start + ROW_STRIP], corpus[start : start + ROW_STRIP], asking)
            return
        for start in range(0, len(asking), QUERY_STRIP):
            strip = asking[start : start + QUERY_STRIP]
            scores = distances(corpus, self.queries[strip], self.metric)
            if self.skip_self:
                scores[ids[:, None] == self.query_ids[strip][None, :]] = np.nan
            # Ties with the k-th best stay in, for the id to decide; NaN is never near.
            near = scores <= self.limit[strip]
            for column in np.flatnonzero(near.any(axis=0)):
                rows = near[:, column]
                self._merge(int(strip[column]), ids[rows], scores[rows, column])

    def _merge(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.found:
            ids = np.concatenate([self.found[query][0], ids])
            scores = np.concatenate([self.found[query][1], scores])
            if self.distinct:
                ids, first = np.unique(ids, return_index=True)
                scores = scores[first]
        best = nearest(ids, scores, self.k)
        self.found[query] = ids[best], scores[best]
        if len(best) == self.k:
            self.limit[query] = scores[best[-1]]

    def table(self) -> pa.Table:
        """(query_id, id, distance) of everything kept."""
        kept = sorted(self.found)
        sizes = [len(self.found[q][0]) for q in kept]
        ids = [self.found[q][0] for q in kept] or [np.empty(0, np.int64)]
        scores = [self.found[q][1] for q in kept] or [np.empty(0)]
        return pa.table(
            {
                "query_id": pa.array(np.repeat(self.query_ids[kept], sizes), pa.int64()),
                "id": pa.array(np.concatenate(ids), pa.int64()),
                "distance": pa.array(np.concatenate(scores), pa.float64()),
            }
        )


BatchFunction = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def scan_topk(query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str, skip_self: bool) -> BatchFunction:
    """mapInArrow function over (id, embedding): each task returns its k nearest per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(query_ids, queries, k, metric, skip_self)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), queries.shape[1]))
        yield from best.table().to_batches()

    return run


def scan_cells(
    query_ids: np.ndarray, queries: np.ndarray, cells: np.ndarray, k: int, metric: str, skip_self: bool
) -> BatchFunction:
    """mapInArrow function over (id, embedding, cell): a row meets the queries probing its cell.

    ``cells`` holds the probed cells of each query, one row per query.
    """
    askers: dict[int, list[int]] = {}
    for q, row in enumerate(cells.tolist()):
        for cell in row:
            askers.setdefault(cell, []).append(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(query_ids, queries, k, metric, skip_self, distinct=True)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            corpus = matrix(batch.column(1), queries.shape[1])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            held = batch.column(2).to_numpy(zero_copy_only=False)
            for cell in np.unique(held).tolist():
                if cell in askers:
                    rows = held == cell
                    best.add(ids[rows], corpus[rows], np.array(askers[cell]))
        yield from best.table().to_batches()

    return run


def few_rows(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, so few at a time that their gaps to ``cells`` centres stay in bounds."""
    most = max(1, CELL_GAPS // max(cells, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def best_cells(points: np.ndarray, centers: np.ndarray, nprobe: int) -> np.ndarray:
    """(points, nprobe) numbers of the centres with the largest inner product."""
    return np.argsort(-(points @ centers.T), axis=1, kind="stable")[:, : min(nprobe, len(centers))]


def cell_positions(centers: np.ndarray) -> BatchFunction:
    """mapInArrow function over (embedding, cell): the place of the cell among the vector's best, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, len(centers)):
            order = best_cells(matrix(batch.column(0), centers.shape[1]), centers, len(centers))
            cells = batch.column(1).to_numpy(zero_copy_only=False)
            place = (order == cells[:, None]).argmax(axis=1) + 1
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32())], names=["place"])

    return run


def probe_cells(centers: np.ndarray, nprobe: int) -> BatchFunction:
    """mapInArrow function over (id, embedding): one row per query and probed cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, len(centers)):
            cells = best_cells(matrix(batch.column(1), centers.shape[1]), centers, nprobe)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(cells.ravel().astype(np.int32))],
                names=["query_id", "embedding", "cell"],
            )

    return run
