"""Repeated passages of 50 words or more across documents, found by fixed-block anchors.

Every document is also a reference: its words are cut into blocks of 25 that do not overlap. Any 50
consecutive words hold one whole block, so a passage of an earlier document can only come back
where one of its blocks does. Every rolling window of 25 words probes the blocks
(:mod:`exchange`). Around the hits, and only there, windows of 50 words are extended: each is
hashed and the smallest document that has it is found by bucket; windows that follow one another
make up the maximal repeat. No pair of documents is ever formed, so a passage that a third of all
documents share costs each of them its own windows only.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from groundwork.llm.arrow import schema_with
from groundwork.llm.exchange import MESSAGE, _FIELDS, answers, ask, asked, buckets_of, chunked, heard, messages, place
from groundwork.llm.registry import query, table
from groundwork.llm.words import U, Words, gram_hashes, slices, texts_of, within

WINDOW = 50
_NONE = np.iinfo(np.int64).max


def _ids(part: pa.Table) -> np.ndarray:
    """Identifiers as numbers; null is later than every other."""
    return part["doc_id"].cast(pa.int64()).combine_chunks().fill_null(_NONE).to_numpy()


def _blocks(chunk: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rolling windows of ``size`` words, and of the blocks among them."""
    rolling, anchors = [np.empty(0, U)], [np.empty(0, U)]
    for part in slices(chunk, "text"):
        words = Words(*texts_of(part["text"]))
        at = within(words.first, size)
        h = gram_hashes(words.hashes(), size)[at] if len(at) else np.empty(0, U)
        rolling.append(h)
        if len(at):
            own = words.first[np.searchsorted(words.first, at, "right") - 1]
            anchors.append(h[(at - own) % size == 0])
    return np.concatenate(rolling), np.concatenate(anchors)


def _candidates(chunk: pa.Table, hit: np.ndarray, block: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that hold a hit block window, and the document of each.

    ``hit`` tells for each rolling block window, in the order of :func:`_blocks`, whether it is one.
    """
    hashes, owners, used = [np.empty(0, U)], [np.empty(0, np.int64)], 0
    for part in slices(chunk, "text"):
        words = Words(*texts_of(part["text"]))
        small, large = within(words.first, block), within(words.first, window)
        struck = np.zeros(len(words.starts) + 1, np.int64)
        struck[small + 1] = hit[used : used + len(small)]
        used += len(small)
        if not len(large):
            continue
        total = np.cumsum(struck)
        keep = large[total[large + window - block + 1] > total[large]]
        if len(keep):
            hashes.append(gram_hashes(words.hashes(), window)[keep])
            owners.append(_ids(part)[np.searchsorted(words.first, keep, "right") - 1])
    return np.concatenate(hashes), np.concatenate(owners)


def _smallest(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the smallest owner of each."""
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    return hashes[first], owners[first]


_PAIR = np.dtype([("h", "<u8"), ("owner", "<i8")])


def _earlier(bucket: pa.Table) -> pa.Table:
    """To each chunk: the hashes that a smaller document elsewhere has."""
    packed = bucket["packed"].to_pylist()
    pairs = np.frombuffer(b"".join(packed), _PAIR)
    hashes, least = _smallest(pairs["h"].copy(), pairs["owner"].copy())
    out, at = [], 0
    for p in packed:
        own = pairs[at : at + len(p) // _PAIR.itemsize]
        at += len(own)
        late = own["h"][least[np.searchsorted(hashes, own["h"])] < own["owner"]]
        out.append(late.tobytes() if len(late) else None)
    replies = bucket.set_column(bucket.schema.get_field_index("packed"), "packed", pa.array(out, pa.binary()))
    return replies.filter(pa.array([p is not None for p in out])).select(["chunk", "bucket", "packed"]).cast(_FIELDS)


def _spans(covered: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, text, spans.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes when it lies in ``window`` consecutive words that
    also start in a document with a smaller doc_id; windows are judged on the input. ``text`` is the
    words that stay, joined by one space; ``spans`` are the removed stretches of words, the maximal
    repeats. doc_id is a whole number; null is later than all others. Rows with the same doc_id do
    not remove each other's words. A null or empty text has no words; texts under ``window`` words
    lose none. An empty table gives no rows. Other columns are not looked at.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    block, dealt, buckets = (window + 1) // 2, chunked(docs, id_column, text_column), buckets_of(docs)
    replies = answers(ask(dealt, lambda chunk: _blocks(chunk, block), buckets))

    def extend(chunk: pa.Table, reply: pa.Table) -> pa.Table:
        if not chunk.num_rows or not reply.num_rows:
            return _FIELDS.empty_table()
        rolling, anchors = _blocks(chunk, block)
        places, _ = asked(rolling, anchors, buckets)
        hit = heard(places, reply)[np.searchsorted(places, place(rolling, buckets))]
        hashes, owners = _smallest(*_candidates(chunk, hit, block, window))
        spot = place(hashes, buckets)
        order = np.argsort(spot, kind="stable")
        pairs = np.empty(len(hashes), _PAIR)
        pairs["h"], pairs["owner"] = hashes[order], owners[order]
        return messages(chunk["chunk"][0].as_py(), spot[order], pairs)

    windows = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(extend, MESSAGE)
    verdicts = windows.groupBy("bucket").applyInArrow(_earlier, MESSAGE)
    schema = schema_with(docs, {"doc_id": id_column}, "n_words long, n_removed long, text string, spans array<struct<start: long, stop: long>>")
    arrow = to_arrow_schema(schema)

    def remove(chunk: pa.Table, reply: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return arrow.empty_table()
        late = np.sort(np.frombuffer(b"".join(reply["packed"].to_pylist()), U))
        # Inside the chunk, a window's smallest document is known without asking.
        hashes, owners = [np.empty(0, U)], [np.empty(0, np.int64)]
        for part in slices(chunk, "text"):
            words = Words(*texts_of(part["text"]))
            at = within(words.first, window)
            if len(at):
                hashes.append(gram_hashes(words.hashes(), window)[at])
                owners.append(_ids(part)[np.searchsorted(words.first, at, "right") - 1])
        hashes, owners = np.concatenate(hashes), np.concatenate(owners)
        known, least = _smallest(hashes, owners)
        gone = owners > least[np.searchsorted(known, hashes)] if len(known) else np.zeros(0, bool)
        if len(late):
            gone |= late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes
        used, out = 0, []
        for part in slices(chunk, "text"):
            words = Words(*texts_of(part["text"]))
            at = within(words.first, window)
            depth = np.zeros(len(words.starts) + 1, np.int64)
            bad = at[gone[used : used + len(at)]]
            used += len(at)
            np.add.at(depth, bad, 1)
            np.add.at(depth, bad + window, -1)
            covered = np.cumsum(depth)[:-1] > 0
            removed = np.concatenate([[0], np.cumsum(covered)])[words.first]
            bytes_, offsets = words.data.tobytes(), words.offsets.tolist()
            rows = []
            for r, name in enumerate(part["doc_id"].to_pylist()):
                own = bytes_[offsets[r] : offsets[r + 1]].split()
                lost = int(removed[r + 1] - removed[r])
                spans = []
                if lost:
                    mask = covered[words.first[r] : words.first[r + 1]]
                    spans = _spans(mask)
                    rest = itertools.compress(own, (~mask).tolist())
                else:
                    rest = own
                rows.append((name, len(own), lost, b" ".join(rest).decode(), spans))
            out.append(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow))
        return pa.concat_tables(out)

    return dealt.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(remove, schema)


@query("op2_substring_dedup")
def op2(spark: SparkSession, directory: str) -> DataFrame:
    out = substring_dedup(table(spark, directory, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
