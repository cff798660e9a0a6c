"""Lloyd's clustering over dictionary-encoded vectors, in exact integers.

Vectors are cut into blocks of dimensions. A chunk of vectors keeps, for every block, its distinct
subvectors and one code a vector: nothing is lost. A block whose subvectors are mostly distinct is
halved, down to single dimensions, where whole numbers repeat. The encoded chunks are written once. A
round computes the distance of every distinct subvector to the centroids once, and a vector's distance
is the sum of its codes' entries. Sums of a cluster come from the dictionaries too, weighted by how
often a code occurs in it.

A dictionary belongs to its chunk, so it is bounded by the chunk and never sent anywhere. What leaves
a task is one count and one sum of vectors per cluster; the driver holds only centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from groundwork.llm.registry import query, table
from groundwork.llm.storage import stored

#: Vectors of one chunk, and dimensions of the widest block.
CHUNK, WIDEST = 16_384, 8
#: Scaled components stay below this, so that a squared distance of up to 64 dimensions fits 64 bits.
LARGEST = 1 << 27

BLOCK = "struct<at:int,width:int,entries:binary,codes:binary>"
PARTS = "cluster int, n bigint, inertia decimal(38,0), sums array<decimal(38,0)>"


def _encoded(vectors: np.ndarray, at: int, width: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first dimension, width, distinct subvectors, codes) for the blocks that the dimensions end up in."""
    part = np.ascontiguousarray(vectors[:, at : at + width])
    entries, codes = np.unique(part.view([("", part.dtype)] * width).ravel(), return_inverse=True)
    if width > 1 and 2 * len(entries) > len(part):
        half = width // 2
        return _encoded(vectors, at, half) + _encoded(vectors, at + half, width - half)
    return [(at, width, entries.view(part.dtype).reshape(len(entries), width), codes.astype(np.uint16 if len(entries) <= 1 << 16 else np.uint32))]


def _decoded(block: dict) -> tuple[int, int, np.ndarray, np.ndarray]:
    entries = np.frombuffer(block["entries"], np.int64).reshape(-1, block["width"])
    return block["at"], block["width"], entries, np.frombuffer(block["codes"], np.uint16 if len(entries) <= 1 << 16 else np.uint32)


def encode(vectors: DataFrame, id_column: str, vector_column: str, dims: int, scale: int, chunk: int = CHUNK, widest: int = WIDEST) -> DataFrame:
    """Encoded chunks of the vectors of ``dims`` finite components; see :func:`cluster_vectors`."""
    value = F.col(vector_column)
    usable = F.size(value).eqNullSafe(dims) & F.forall(value, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_column).alias("id"), value.cast("array<double>").alias("v")).where(usable)
    id_type = kept.schema["id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *T.StructType.fromDDL(f"n int, blocks array<{BLOCK}>").fields])
    out = to_arrow_schema(schema)

    def pack(ids: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        scaled = np.floor(values * scale)
        if len(scaled) and np.abs(scaled).max() >= LARGEST:
            raise ValueError(f"a component times {scale} reaches {LARGEST}: its squared distances do not fit a long")
        whole = scaled.astype(np.int64)
        blocks = [b for at in range(0, dims, widest) for b in _encoded(whole, at, min(widest, dims - at))]
        rows = [{"at": a, "width": w, "entries": e.tobytes(), "codes": c.tobytes()} for a, w, e, c in blocks]
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([lists.cast(out.field(0).type), pa.array([len(ids)], pa.int32()), pa.array([rows], out.field(2).type)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            if not rows.num_rows:
                return
            ids, lists = rows.column("id").chunk(0), rows.column("v").chunk(0)
            yield pack(ids, lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))

        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                piece = batch.slice(at, chunk)
                if held and n + piece.num_rows > chunk:
                    yield from flush()
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if held:
            yield from flush()

    return kept.mapInArrow(run, schema)


def _nearest(blocks: list, n: int, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; ties go to the smaller number."""
    total = np.zeros((n, len(centroids)), np.int64)
    for at, width, entries, codes in blocks:
        gap = entries[:, None, :] - centroids[None, :, at : at + width]
        total += (gap * gap).sum(axis=2)[codes]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(n), cluster]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            yield one.column("ids").flatten(), [_decoded(b) for b in one.column("blocks")[0].as_py()]


def _round(encoded: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """cluster -> (vectors, summed squared distance, sums by dimension) of the vectors nearest to each centroid."""
    k, dims = centroids.shape
    out = to_arrow_schema(T.StructType.fromDDL(PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = [0] * k, [0] * k, np.zeros((k, dims), object)
        for ids, blocks in _chunks(batches):
            cluster, distance = _nearest(blocks, len(ids), centroids)
            for c in np.unique(cluster).tolist():
                mine = cluster == c
                n[c] += int(mine.sum())
                # Halves of a distance are summed apart, so that the sum of a chunk fits.
                inertia[c] += (int((distance[mine] >> 32).sum()) << 32) + int((distance[mine] & 0xFFFFFFFF).sum())
                for at, width, entries, codes in blocks:
                    times = np.bincount(codes[mine], minlength=len(entries))
                    sums[c, at : at + width] += (times @ entries).astype(object)
        used = [c for c in range(k) if n[c]]
        columns = [used, [n[c] for c in used], [_decimal(inertia[c]) for c in used], [[_decimal(x) for x in sums[c]] for c in used]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, out.types, strict=True)], schema=out)

    parts = encoded.mapInArrow(run, PARTS)
    added = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("inertia").cast("decimal(38,0)").alias("inertia"), *(F.sum(F.col("sums")[d]).cast("decimal(38,0)").alias(f"s{d}") for d in range(dims))
    )
    return {r["cluster"]: (r["n"], int(r["inertia"]), [int(r[f"s{d}"]) for d in range(dims)]) for r in added.collect()}


def _decimal(x):
    from decimal import Decimal

    return Decimal(int(x))


def cluster_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: int = 3,
    chunk: int = CHUNK,
    widest: int = WIDEST,
) -> tuple[DataFrame, list[list[int]]]:
    """(one row per clustered vector, final centroids as whole numbers).

    Columns: id (of the type of ``id_column``), cluster, distance (squared), cluster_inertia, inertia,
    centroid (array<bigint>). Vectors that are null, have other than ``dims`` components, or hold a
    null, NaN or infinite one, are left out. Components become floor(``scale`` * x). The first centroids
    are the vectors with the ``k`` smallest SHA-256 of "``seed``:id" (null ids come last; rows with one id by
    their components); with fewer vectors there are as many centroids. Each of ``rounds`` rounds assigns
    and moves every centroid that has vectors to floor(sum / count); then all are assigned once more.
    Ties go to the smaller cluster. Repeated rows and ids are clustered row by row, other columns are not
    looked at, and an empty table gives no rows and no centroids. A component that reaches 2**27 after scaling raises.
    """
    if dims > 64 or dims < 1 or k < 1 or chunk < 1 or widest < 1:
        raise ValueError("dims must be from 1 to 64, k, chunk and widest at least 1")
    value = F.col(vector_column)
    encoded = stored(encode(vectors, id_column, vector_column, dims, scale, chunk, widest), "encoded")
    usable = F.size(value).eqNullSafe(dims) & F.forall(value, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")).cast("binary"), 256)
    first = vectors.where(usable).select(order.alias("order"), value.cast("array<double>").alias("v"))
    # At most k rows come to the driver.
    head = first.orderBy(F.col("order").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.floor(np.array([r.v for r in head], float).reshape(-1, dims) * scale).astype(np.int64)
    if not head:
        return _rows(encoded, centroids, {}), []
    for _ in range(rounds):
        for cluster, (n, _, sums) in _round(encoded, centroids).items():
            centroids[cluster] = [s // n for s in sums]
    return _rows(encoded, centroids, _round(encoded, centroids)), centroids.tolist()


def _rows(encoded: DataFrame, centroids: np.ndarray, last: dict) -> DataFrame:
    schema = T.StructType(
        [T.StructField("id", encoded.schema["ids"].dataType.elementType), *T.StructType.fromDDL("cluster int, distance bigint").fields]
    )
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, blocks in _chunks(batches):
            cluster, distance = _nearest(blocks, len(ids), centroids)
            yield pa.RecordBatch.from_arrays([ids.cast(out.types[0]), pa.array(cluster, pa.int32()), pa.array(distance)], schema=out)

    total = sum(part[1] for part in last.values())
    by_cluster = [
        F.create_map(*(x for c, (_, inertia, _) in last.items() for x in (F.lit(c), F.lit(inertia).cast("bigint"))))[F.col("cluster")] if last else F.lit(None).cast("bigint"),
        F.lit(total).cast("bigint"),
        F.create_map(*(x for c in last for x in (F.lit(c), F.array(*map(F.lit, centroids[c].tolist())).cast("array<bigint>"))))[F.col("cluster")]
        if last
        else F.lit(None).cast("array<bigint>"),
    ]
    names = ["cluster_inertia", "inertia", "centroid"]
    return encoded.mapInArrow(run, schema).select("*", *(c.alias(n) for c, n in zip(by_cluster, names, strict=True)))


def digest(centroid: list[int]) -> str:
    """SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    nearest = "list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    text = f"""
WITH k AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('3:' || vec_id) AS h, v FROM k) ORDER BY h, v LIMIT {k}),
"""
    for i in range(rounds + 1):
        text += f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, {nearest} AS d FROM k, c{i}) GROUP BY r),\n"
        if i < rounds:
            text += f"""s{i} AS MATERIALIZED (
    SELECT c, list(s ORDER BY p) AS m FROM (
        SELECT c, p, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*))::BIGINT AS s
        FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS p FROM a{i} JOIN k USING (r)) GROUP BY c, p) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(s.m, o.m) AS m FROM c{i} AS o LEFT JOIN s{i} AS s USING (c)),
"""
    return text + f"""z AS (SELECT c, sum(d)::BIGINT AS i FROM a{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, i AS cluster_inertia, (SELECT sum(i) FROM z)::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN k USING (r) JOIN c{rounds} USING (c) JOIN z USING (c)
"""


OP12_SQL = _op12_sql()


@query("op12_centroid_clusters", OP12_SQL)
def op12(spark: SparkSession, directory: str) -> DataFrame:
    found, _ = cluster_vectors(table(spark, directory, "embeddings"))
    named = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", named.alias("centroid_sha256"))
