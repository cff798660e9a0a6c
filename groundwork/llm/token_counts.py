"""Tokens attributed to sections of documents through the bytes they cover.

Every document is encoded once as a whole. Its tokens cover its bytes without gaps, so their spans
are running sums of token lengths; sections are spans too, and both meet in an interval join
inside the task that holds the document. Nothing is shuffled.

The rule for a token that crosses a boundary: it goes to the section that holds most of its bytes,
of equal shares to the earlier section. A token none of whose bytes lie in a section goes to none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.arrow import map_rows, schema_with
from groundwork.llm.registry import query, table
from groundwork.llm.tokens import Encoder, default_vocabulary


def attribute(ids: np.ndarray, lengths: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of each section, how many of them cross its boundary, and tokens in no section.

    Sections are sorted by start and do not overlap.
    """
    size = lengths[ids]
    stop = np.cumsum(size)
    start = stop - size
    low = np.searchsorted(stops, start, "right")  # first section that ends behind the token's start
    high = np.searchsorted(starts, stop, "left") - 1  # last section that starts before its end
    owner = np.where(low <= high, low, -1)
    # Of the few tokens that meet several sections, the largest share decides.
    for t in np.flatnonzero(high > low):
        s = np.arange(low[t], high[t] + 1)
        share = np.minimum(stops[s], stop[t]) - np.maximum(starts[s], start[t])
        owner[t] = s[np.argmax(share)]
    own = owner >= 0
    held = owner[own]
    crossing = (start[own] < starts[held]) | (stop[own] > stops[held])
    return (
        np.bincount(held, minlength=len(starts)),
        np.bincount(held[crossing], minlength=len(starts)),
        int((~own).sum()),
    )


def line_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines of a text, each with its line feed; an empty text has one empty line."""
    feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    starts = np.concatenate([[0], feeds])
    return starts, np.append(feeds, len(data))


def tidy(spans: list[dict]) -> list[tuple[int, str, int, int]]:
    """(place in the given list, name, start, stop) by start; where two overlap, the earlier ends."""
    order = sorted(
        (s["start"], s["stop"], k, s["name"]) for k, s in enumerate(spans or []) if s and None not in (s["start"], s["stop"]) and s["start"] <= s["stop"]
    )
    out = []
    for i, (start, stop, k, name) in enumerate(order):
        out.append((k, name, start, min(stop, order[i + 1][0]) if i + 1 < len(order) else stop))
    return out


def count_tokens(
    docs: DataFrame, sections_column: str | None = None, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document and section: doc_id, section, name, start, stop, n_tokens, n_crossing.

    ``sections_column`` holds array<struct<name: string, start: long, stop: long>> in bytes of the
    text; without it every line is a section, its line feed included, named after its number.
    Sections need not cover the text: tokens outside all of them are counted in a row whose section
    is null, if there are any. Null spans and spans that end before they start are left out; where
    two overlap, the earlier one ends at the start of the later one. A null text is the empty
    text, which has no tokens and, without ``sections_column``, one empty line. Repeated rows each
    have their rows, a null identifier is kept; other columns, whatever their names, are not looked at.
    An empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    picked = [F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")]
    if sections_column:
        picked.append(F.col(sections_column).alias("sections"))
    schema = schema_with(docs, {"doc_id": id_column}, "section long, name string, start long, stop long, n_tokens long, n_crossing long")
    fields = [f.name for f in schema.fields]

    def work(tables):
        encoder = Encoder.of(path)
        lengths = encoder.lengths()
        for part in tables:
            rows = []
            spans = part["sections"].to_pylist() if sections_column else [None] * part.num_rows
            for name, text, given in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), spans, strict=True):
                data = (text or "").encode()
                if sections_column:
                    kept = tidy(given)
                    starts, stops = (np.array([s[i] for s in kept], np.int64) for i in (2, 3))
                    labels = [(s[0], s[1]) for s in kept]
                else:
                    starts, stops = line_spans(data)
                    labels = [(i, str(i)) for i in range(len(starts))]
                ids = np.frombuffer(encoder.ids(text or ""), encoder.dtype)
                counts, crossing, outside = attribute(ids, lengths, starts, stops)
                rows += [
                    (name, *label, *four)
                    for label, four in zip(labels, zip(starts.tolist(), stops.tolist(), counts.tolist(), crossing.tolist(), strict=True), strict=True)
                ]
                if outside:
                    rows.append((name, None, None, None, None, outside, 0))
            if rows:
                yield dict(zip(fields, zip(*rows, strict=True), strict=True))

    return map_rows(docs.select(*picked), schema, work, keeps="encoders")


@query("op7_token_counts")
def op7(spark: SparkSession, directory: str) -> DataFrame:
    """Tokens of every line of every document."""
    return count_tokens(table(spark, directory, "documents")).drop("name")
