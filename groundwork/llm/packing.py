"""Token sequences packed along a space-filling curve.

Each document's token ids are hashed to vectors in three dimensions and averaged; the Hilbert key
of that point, then a hash of doc_id among equal points, orders the corpus so that neighbours are
alike. Rows are dealt by ranges of that order, the ranges' token totals give every range its place,
and each task cuts its stretch of the endless sequence at multiples of the sequence length: only
the last sequence is padded. Equal documents may be a third of all rows: the hash of doc_id parts
them, so no range holds more than its share.

The driver sees one total and one bound per range, as many as there are shuffle partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from groundwork.llm.arrow import forget, map_rows, schema_with
from groundwork.llm.registry import query, table
from groundwork.llm.storage import partitions, stored
from groundwork.llm.tokens import Encoder, default_vocabulary
from groundwork.llm.words import U, mix

#: Bytes of text a task encodes at a time.
SLICE = 1 << 20
LENGTH = 2048
END = 1
DIMENSIONS, BITS = 3, 10
#: Bits of the order that part documents at one point of the curve; 52 in all, exact as doubles.
TIE_BITS = 22


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of rows of coordinates below ``2 ** bits``."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def directions(size: int) -> np.ndarray:
    """A hashed whole-number vector for each token id, so that sums are exact in any order."""
    ids = np.arange(size, dtype=U)
    return np.stack([(mix(ids * U(DIMENSIONS) + U(d)) % U(2001)).astype(np.int64) - 1000 for d in range(DIMENSIONS)], axis=1)


def curve_keys(ids: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert key of the mean vector of each row's ids; rows without ids lie at the centre."""
    sums = np.zeros((len(counts), DIMENSIONS), np.int64)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        for d in range(DIMENSIONS):
            sums[full, d] = np.add.reduceat(table[ids, d], starts)
    # Means of 2,001 even values seldom leave a quarter of their range.
    mean = sums / np.maximum(counts, 1)[:, None]
    cells = np.clip(np.floor((mean + 250) * (1 << BITS) / 500), 0, (1 << BITS) - 1)
    return hilbert_keys(cells)


def token_table(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """(doc_id, place, n, ids): the ids of each document with ``end``, and its place in the order."""
    schema = schema_with(docs, {"doc_id": "doc_id"}, "point long, n long, ids binary")

    def work(tables):
        encoder = Encoder.of(vocabulary)
        vectors = directions(max(encoder.tokenizer.get_vocab_size(), end + 1))
        last = np.array([end], encoder.dtype).tobytes()
        for part in tables:
            found = [encoder.ids(t or "") for t in part["text"].to_pylist()]
            counts = np.array([len(f) for f in found], np.int64) // encoder.dtype.itemsize
            points = curve_keys(np.frombuffer(b"".join(found), encoder.dtype), counts, vectors)
            yield {"doc_id": part["doc_id"], "point": points, "n": counts + 1, "ids": [f + last for f in found]}

    tie = F.pmod(F.xxhash64("doc_id"), F.lit(1 << TIE_BITS))
    coded = map_rows(docs.select("doc_id", "text"), schema, work, most=SLICE, keeps="encoders")
    return stored(coded.select("doc_id", (F.shiftleft("point", TIE_BITS) + tie).alias("place"), "n", "ids"), "tokens", long_rows=True)


def pack_documents(
    docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers; every document ends
    with ``end``, so a null or empty text is that one id. Sequences have ``length`` ids, all but
    the last full. Rows at the same place are ordered by doc_id (null first), then ids, so the
    result does not depend on the partitions. Repeated rows are packed once each. An empty table
    gives no rows. Other columns are not looked at.
    """
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    tokens = token_table(own, vocabulary or default_vocabulary(), end)
    ranges = 4 * partitions(docs)
    bounds = np.array(sorted(set(tokens.approxQuantile("place", [i / ranges for i in range(1, ranges)], 0.25 / ranges))))

    @F.pandas_udf("long")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(), "right"))

    placed = tokens.withColumn("range", range_of("place"))
    totals = dict(placed.groupBy("range").agg(F.sum("n")).collect())
    before, base = 0, {}
    for number in sorted(totals):
        base[number] = before
        before += totals[number]
    dealt = placed.repartition(partitions(docs), "range").sortWithinPartitions("range", "place", "doc_id", "n", "ids")
    schema = schema_with(docs, {"doc_id": id_column}, "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    arrow = to_arrow_schema(schema)

    def pieces(batches):
        forget()  # the encoder and the pieces of text it knows
        now, at = None, 0
        for batch in batches:
            names, rows = batch.column("doc_id").to_pylist(), []
            ranged, counts, found = (batch.column(c).to_pylist() for c in ("range", "n", "ids"))
            for name, number, n, ids in zip(names, ranged, counts, found, strict=True):
                if number != now:
                    now, at = number, base[number]
                wide = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                start = 0
                while start < n:
                    offset = (at + start) % length
                    size = min(n - start, length - offset)
                    rows.append((name, start, size, wide[start : start + size].tobytes(), n, (at + start) // length, offset))
                    start += size
                at += n
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return dealt.mapInArrow(pieces, schema)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids instead of the ids.

    One row per piece, repeated pieces too; a null doc_id stays null, no pieces give no rows.
    """
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def brute_force(texts: list[tuple[int, str | None]], vocabulary: str, end: int = END) -> dict[int, tuple[int, int]]:
    """For tests: tokens and CRC-32 of each whole document, encoded without pieces."""
    encoder = Encoder(vocabulary)
    out = {}
    for name, text in texts:
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out[name] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    return out


@query("op4_packing")
def op4(spark: SparkSession, directory: str) -> DataFrame:
    return digest(pack_documents(table(spark, directory, "documents")))
