"""Which of very many hashes occur more than once, without sending a row for each.

Documents are dealt into chunks. Each chunk sorts its distinct hashes and sends them packed, one
message per bucket of the hash space, four bytes a hash: 30 bits of the hash and two flags. A
bucket answers each chunk with one bit per hash. The chunk, which computes the same sorted list
again, reads the answer off it. A hash that a third of all documents hold reaches its bucket once
per chunk, and every task holds one chunk or one bucket, both shares of the data that shrink with
the number of shuffle partitions.

Bucket and 30 bits together may collide, which only adds candidates; whoever asks compares whole
hashes afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.storage import partitions
from groundwork.llm.words import U

MESSAGE = "chunk int, bucket int, packed binary"
_FIELDS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary())])


def chunked(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text, chunk), dealt by a hash of both, so that no id and no text makes a chunk large."""
    n = partitions(docs)
    chunk = F.pmod(F.xxhash64(F.col(id_column), F.col(text_column)), F.lit(2 * n)).cast("int")
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), chunk.alias("chunk"))
    return picked.repartition(n, "chunk")


def buckets_of(docs: DataFrame) -> int:
    return 2 * partitions(docs)


def place(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 30 bits of each hash in one number."""
    return ((hashes >> U(32)) % U(buckets)) << U(30) | (hashes & U((1 << 30) - 1))


def messages(chunk: int, places: np.ndarray, payload: np.ndarray) -> pa.Table:
    """One message per bucket from sorted places and one payload item each."""
    bucket = (places >> U(30)).astype(np.int32)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.empty(0, np.int64)
    edges = np.append(cuts, len(bucket)) * payload.dtype.itemsize
    body = np.ascontiguousarray(payload).tobytes()
    packed = [body[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return pa.table([pa.array([chunk] * len(cuts), pa.int32()), pa.array(bucket[cuts], pa.int32()), pa.array(packed, pa.binary())], schema=_FIELDS)


def asked(hashes: np.ndarray, anchors: np.ndarray | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct places and what is sent for each: its 30 bits, whether a place comes twice
    here, and whether it is one of ``anchors``."""
    places, count = np.unique(place(hashes, buckets), return_counts=True)
    word = (places & U((1 << 30) - 1)).astype(np.uint32) << np.uint32(2) | (count > 1).astype(np.uint32) << np.uint32(1)
    if anchors is None:
        word |= np.uint32(1)
    elif len(anchors):
        word |= np.isin(places, place(anchors, buckets)).astype(np.uint32)
    return places, word


def _answer(table: pa.Table) -> pa.Table:
    packed = table["packed"].to_pylist()
    size = np.array([len(p) // 4 for p in packed])
    word = np.frombuffer(b"".join(packed), np.uint32)
    order = np.argsort(word >> np.uint32(2), kind="stable")
    key = word[order] >> np.uint32(2)
    first = np.flatnonzero(np.diff(key, prepend=np.uint32(0xFFFFFFFF)) != 0)
    group = np.cumsum(np.diff(key, prepend=np.uint32(0xFFFFFFFF)) != 0) - 1
    flags = np.bitwise_or.reduceat(word[order], first) if len(first) else word
    several = (np.diff(np.append(first, len(key))) > 1) | (flags & 2 > 0)
    shared = np.empty(len(word), bool)
    shared[order] = (several & (flags & 1 > 0))[group]
    ends = np.cumsum(size)
    bits = [np.packbits(shared[b - n : b]).tobytes() if shared[b - n : b].any() else None for b, n in zip(ends, size, strict=True)]
    out = table.set_column(table.schema.get_field_index("packed"), "packed", pa.array(bits, pa.binary()))
    return out.filter(pa.array([b is not None for b in bits])).select(["chunk", "bucket", "packed"]).cast(_FIELDS)


def answers(sent: DataFrame) -> DataFrame:
    """Of messages: for every chunk and bucket the bits of the hashes that occur twice or more, at
    least once as an anchor. Messages without any are not answered."""
    return sent.groupBy("bucket").applyInArrow(_answer, MESSAGE)


def heard(places: np.ndarray, reply: pa.Table) -> np.ndarray:
    """The answer for each of the sorted places that were asked."""
    out = np.zeros(len(places), bool)
    edge = np.searchsorted(places >> U(30), reply["bucket"].to_numpy().astype(U), "left")
    stop = np.searchsorted(places >> U(30), reply["bucket"].to_numpy().astype(U), "right")
    for a, b, packed in zip(edge.tolist(), stop.tolist(), reply["packed"].to_pylist(), strict=True):
        out[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(bool)
    return out


def ask(docs: DataFrame, hashes: Callable[[pa.Table], tuple[np.ndarray, np.ndarray | None]], buckets: int) -> DataFrame:
    """The messages of all chunks; ``hashes`` gives the hashes of a chunk and its anchors."""

    def send(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _FIELDS.empty_table()
        return messages(table["chunk"][0].as_py(), *asked(*hashes(table), buckets))

    return docs.groupBy("chunk").applyInArrow(send, MESSAGE)
