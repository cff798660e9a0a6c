"""Benchmark contamination found by templates, re-parameterised questions included.

Words are runs of letters and digits. A template replaces numbers, names (capitalised words) and
units after numbers by typed placeholders, one for a run of numbers or of names; the literal form
only folds case. Windows of both forms of the benchmark are hashed, and every window of every
document looks them up; hits join the benchmark by hash. A template window with too few plain words
is looked at only where neighbouring hits lead to one with enough. Hits of one document and item on
neighbouring diagonals (shifts between both) are read together: an item's value stands for one
value of the document, and windows with a slot that says otherwise do not count. A document is
contaminated by an item when the windows that count cover at least half of the item's words.

The lookup holds the hashes of the benchmark, a stated query set, in blocks of about ``BLOCK``
windows, whole items each; each block is one pass over the documents, which are never shuffled.
Only hits are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from groundwork.llm.arrow import map_rows, schema_with
from groundwork.llm.registry import query, table
from groundwork.llm.storage import identity, stored, without_rows
from groundwork.llm.words import ALNUM, LOWER, U, Words, gram_hashes, mix, texts_of, within

WINDOW = 8
#: Literal words a template window needs, so that placeholders alone match nothing.
LITERALS = 5
#: Shorter items match as they are, as a whole.
SHORTEST = 5
SHARE = 0.5
#: Bytes of text whose words, hashes and windows a task holds at a time; they take about forty times as much.
SLICE = 1 << 20
#: Window hashes held by a task at a time: 16 MB.
BLOCK = 2_000_000
#: Fixed list, ours: units that follow a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonnes ounce ounces pound pounds "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years percent dollar dollars euro euros cent cents degree degrees kmh mph w kw kwh v a hz"
).split()
PLAIN, NUMBER, NAME, UNIT = range(4)


def _fold_latin(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals from U+00C0 to U+00DE in lower case."""
    out = LOWER[data]
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 0x20
    return out


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.sort(Words(data, np.array([0, len(data)]), ALNUM).hashes())


class Forms:
    """Words of a slice in both forms: ``literal`` and ``typed`` hashes and the ``kind`` of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, units: np.ndarray):
        folded = _fold_latin(data)
        self.words = w = Words(data, offsets, ALNUM)
        self.folded = folded
        self.literal = Words(folded, offsets, ALNUM).hashes() if len(data) else np.empty(0, U)
        lead = data[w.starts] if len(w.starts) else np.empty(0, np.uint8)
        kind = np.zeros(len(lead), np.uint8)
        capital = (lead >= 65) & (lead <= 90)
        if len(lead):
            follow = data[np.minimum(w.starts + 1, len(data) - 1)]
            capital |= (lead == 0xC3) & (follow >= 0x80) & (follow <= 0x9E) & (follow != 0x97)
        kind[capital] = NAME
        kind[(lead >= 48) & (lead <= 57)] = NUMBER
        if len(lead):
            at = np.minimum(np.searchsorted(units, self.literal), len(units) - 1)
            unit = units[at] == self.literal
            unit[1:] &= kind[:-1] == NUMBER
            unit[0] = False
            unit[w.first[:-1][w.first[:-1] < len(unit)]] = False
            kind[unit] = UNIT
        # Units of the template: a word, or a run of numbers or of names.
        new = np.ones(len(kind), bool)
        if len(kind) > 1:
            start, stop = w.ends[:-1], w.starts[1:]
            same = (kind[1:] == kind[:-1]) & (stop > start)
            number = np.concatenate([[0], np.cumsum(~np.isin(data, np.frombuffer(b" ,./:-'", np.uint8)))])
            name = np.concatenate([[0], np.cumsum(~np.isin(data, np.frombuffer(b" -'\t\n\r", np.uint8)))])
            joined = (kind[1:] == NUMBER) & (stop - start == 1) & (number[stop] == number[start])
            joined |= (kind[1:] == NAME) & (name[stop] == name[start])
            new[1:] = ~(same & joined)
            edges = w.first[:-1]
            new[edges[edges < len(new)]] = True
        self.begin = np.flatnonzero(new)
        self.end = np.append(self.begin[1:], len(kind))[: len(self.begin)]
        self.unit_of = np.cumsum(new) - 1
        self.first_unit = np.searchsorted(self.begin, w.first)
        self.kind = kind[self.begin]
        self.typed = np.where(self.kind == PLAIN, self.literal[self.begin], mix(self.kind.astype(U) + U(0x51ED270B)))

    def literal_windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes)."""
        at = within(self.words.first, size)
        return at, gram_hashes(self.literal, size)[at] if len(at) else np.empty(0, U)

    def typed_windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first units, hashes, whether enough words are plain) of the windows with placeholders."""
        at = within(self.first_unit, size)
        if not len(at):
            return at, np.empty(0, U), np.empty(0, bool)
        plain = np.concatenate([[0], np.cumsum(self.kind == PLAIN)])
        held = plain[at + size] - plain[at]
        some = held < size
        # The two forms never share a hash.
        return at[some], mix(gram_hashes(self.typed, size)[at] + U(1))[some], (held >= min(LITERALS, size - 1))[some]

    def slots(self, unit: int, size: int) -> tuple[list[int], list[str]]:
        """First words and values of a window's placeholders in order; a value begins with its kind."""
        w, at, out = self.words, [], []
        for i in range(unit, unit + size):
            if self.kind[i] != PLAIN:
                at.append(int(self.begin[i]))
                parts = [self.folded[w.starts[k] : w.ends[k]].tobytes().decode() for k in range(self.begin[i], self.end[i])]
                out.append(f"{self.kind[i]}{' '.join(parts)}")
        return at, out


_HIT = "size int, h long, typed boolean, position long, unit long, slots array<string>"


def _windows(items: DataFrame) -> DataFrame:
    """All windows of the items: item_id, n_words, the columns of a hit, words spanned, places of slots, whether anchored."""
    schema = schema_with(items, {"item_id": "item_id"}, f"item bigint, n_words int, {_HIT}, span int, spots array<int>, anchor boolean")
    fields = [f.name for f in schema.fields]

    def work(tables):
        units = _unit_hashes()
        for part in tables:
            rows = []
            ids, keys = part["item_id"].to_pylist(), part["item"].to_pylist()
            forms = Forms(*texts_of(part["text"]), units)
            first, first_unit = forms.words.first, forms.first_unit
            words, wide = np.diff(first), np.diff(first_unit)
            for size in sorted({min(int(n), WINDOW) for n in words if n}):
                at, literal = forms.literal_windows(size)
                for r, p, h in zip((np.searchsorted(first, at, "right") - 1).tolist(), at.tolist(), literal.view(np.int64).tolist(), strict=True):
                    if min(words[r], WINDOW) == size:
                        rows.append((ids[r], keys[r], int(words[r]), size, h, False, p - int(first[r]), int(forms.unit_of[p] - first_unit[r]), [], size, [], True))
            for size in sorted({min(int(n), WINDOW) for n in wide if n >= SHORTEST}):
                at, typed, enough = forms.typed_windows(size)
                for r, c, h, anchor in zip(
                    (np.searchsorted(first_unit, at, "right") - 1).tolist(), at.tolist(), typed.view(np.int64).tolist(), enough.tolist(), strict=True
                ):
                    if min(wide[r], WINDOW) == size:
                        start, p = int(first[r]), int(forms.begin[c])
                        spots, slots = forms.slots(c, size)
                        span = int(forms.end[c + size - 1]) - p
                        rows.append((ids[r], keys[r], int(words[r]), size, h, True, p - start, c - int(first_unit[r]), slots, span, [x - start for x in spots], anchor))
            if rows:
                yield dict(zip(fields, zip(*rows, strict=True), strict=True))

    return map_rows(items, schema, work)


def _hits(docs: DataFrame, sizes: dict[bool, list[int]], block: np.ndarray) -> DataFrame:
    """Windows of ``docs`` whose hash is in the sorted ``block``."""
    schema = schema_with(docs, {"doc_id": "doc_id"}, "doc bigint, " + _HIT)
    fields = [f.name for f in schema.fields]

    def work(tables):
        units = _unit_hashes()
        wanted = block.view(U)
        maybe = np.zeros(1 << 20, bool)
        maybe[wanted >> U(44)] = True

        def found(h: np.ndarray) -> np.ndarray:
            k = np.flatnonzero(maybe[h >> U(44)])
            return k[wanted[np.minimum(np.searchsorted(wanted, h[k]), len(wanted) - 1)] == h[k]]

        for part in tables:
            rows = []
            ids, keys = part["doc_id"], part["doc"]
            forms = Forms(*texts_of(part["text"]), units)
            first = forms.words.first
            anchors, dense = [], []
            for size in sizes[False]:
                at, literal = forms.literal_windows(size)
                k = found(literal)
                rows += [(p, size, h, False, []) for p, h in zip(at[k].tolist(), literal[k].view(np.int64).tolist(), strict=True)]
                anchors.append(forms.unit_of[at[k]])
            for size in sizes[True]:
                at, typed, enough = forms.typed_windows(size)
                k = found(typed)
                anchors.append(at[k][enough[k]])
                dense.append((size, at[k], typed[k].view(np.int64)))
            # Windows with few plain words need neighbours that lead to one with enough, in either form.
            sure = np.unique(np.concatenate([*anchors, np.empty(0, np.int64)]))
            every = np.unique(np.concatenate([sure, *(at for _, at, _ in dense)]))
            run = np.cumsum(np.diff(every, prepend=-2) > 1)
            led = np.isin(run, run[np.searchsorted(every, sure)])
            for size, at, h in dense:
                for c, x in zip(at.tolist(), h.tolist(), strict=True):
                    if led[np.searchsorted(every, c)]:
                        rows.append((int(forms.begin[c]), size, x, True, forms.slots(c, size)[1]))
            if rows:
                row = np.searchsorted(first, [r[0] for r in rows], "right") - 1
                out = [
                    (ids[int(i)].as_py(), keys[int(i)].as_py(), size, h, is_typed, p - int(first[i]), int(forms.unit_of[p] - forms.first_unit[i]), slots)
                    for i, (p, size, h, is_typed, slots) in zip(row, rows, strict=True)
                ]
                yield dict(zip(fields, zip(*out, strict=True), strict=True))

    return map_rows(docs, schema, work, most=SLICE)


def _clashing(typed: list[dict]) -> set[tuple[int, str]]:
    """(place, document's value) of the slots that say otherwise than most slots of the same item value, or the first."""
    seen = sorted({(at, v, d) for r in typed for at, v, d in zip(r["spots"], r["values"], r["slots"], strict=True)})
    votes, early = Counter((v, d) for _, v, d in seen), {}
    for at, v, d in seen:
        early.setdefault((v, d), at)
    stands, taken = {}, {}
    for v, d in sorted(votes, key=lambda x: (-votes[x], early[x])):
        # Names stay apart; several numbers or units may become one.
        if v not in stands and (v[0] != str(NAME) or taken.setdefault(d, v) == v):
            stands[v] = d
    return {(at, d) for at, v, d in seen if stands.get(v) != d}


def _covered(hits: list[dict]) -> tuple[int, int, int]:
    """(words covered, words in literal windows, minus the most frequent shift) of neighbouring diagonals."""
    # Windows with few plain words count on the diagonals of templates that others are on.
    lines = {r["line"] for r in hits if r["anchor"]}
    typed = [r for r in hits if r["typed"] and r["line"] in lines]
    clashing = _clashing(typed)
    fit = [r for r in typed if not any(x in clashing for x in zip(r["spots"], r["slots"], strict=True))]
    literal = [r for r in hits if not r["typed"]]
    exact = {x for r in literal for x in range(r["place"], r["place"] + r["span"])}
    sure = literal + [r for r in fit if r["anchor"]]
    words = {x for r in sure for x in range(r["place"], r["place"] + r["span"])}
    weak = sorted({(r["place"], r["span"]) for r in fit if not r["anchor"]})
    for order in (weak, weak[::-1]):
        for place, span in order:
            if any(x in words for x in range(place - 1, place + span + 1)):
                words.update(range(place, place + span))
    times = Counter(r["shift"] for r in sure)
    return len(words), len(exact), -min(times, key=lambda x: (-times[x], x), default=0)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text", share: float = SHARE, block: int = BLOCK,
) -> DataFrame:
    """One row per contaminated document and benchmark item: doc_id, item_id, n_words, covered, exact, start.

    ``covered`` counts the item's words inside matching windows on the best neighbouring diagonals
    (shifts next to each other differ by half of the item's words, or eight, at most), ``exact``
    those in literal windows there, ``start`` is the document's word (from 0) where the item would
    begin by most windows. Items of up to eight words match as a whole, those under five only in
    their literal form. A null or empty text matches nothing; a null doc_id or item_id is reported as null.
    Repeated documents or items give their pair once. No hits, or an empty table, give no rows.
    Other columns are not looked at.
    """
    own = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(F.col(id_column), F.col(text_column)).alias("doc")
    )
    items = benchmark.select(
        F.col(item_id_column).alias("item_id"), F.col(item_text_column).alias("text"),
        F.xxhash64(F.col(item_id_column), F.col(item_text_column)).alias("item"),
    ).dropDuplicates(["item"])
    windows = stored(_windows(items), "benchmark-windows")
    facts = windows.agg(F.count_distinct("h").alias("n")).first()
    blocks = max(1, -(-facts["n"] // block))
    sizes = {False: [], True: []}
    for r in windows.select("typed", "size").distinct().collect():
        sizes[r["typed"]].append(r["size"])
    # Whole items to a block, so that a pass sees all windows that may lead to each other.
    windows = windows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    found = None
    for number in range(blocks):
        rows = windows.where(F.col("block") == number).select("h").distinct().collect()
        if rows:
            wanted = np.sort(np.array([r["h"] for r in rows], np.int64).view(U)).view(np.int64)
            part = _hits(own, sizes, wanted).withColumn("block", F.lit(number))
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = own.select("doc_id", "doc").where("false").selectExpr(
            "doc_id", "doc", "0 AS size", "0L AS h", "false AS typed", "0L AS position", "0L AS unit", "CAST(array() AS array<string>) AS slots", "0 AS block"
        )
    hits = stored(found.distinct(), "benchmark-hits", long_rows=True)
    theirs = windows.withColumnRenamed("position", "place").withColumnRenamed("slots", "values").withColumnRenamed("unit", "step")
    met = hits.join(theirs, ["block", "size", "h", "typed"]).withColumn("shift", F.col("position") - F.col("place"))
    met = met.select("doc", "doc_id", "item", "item_id", "n_words", "typed", "anchor", "place", "span", "shift", (F.col("unit") - F.col("step")).alias("line"), "spots", "values", "slots")
    schema = schema_with(met, {"doc_id": "doc_id", "item_id": "item_id"}, "n_words int, covered int, exact int, start long")
    arrow = to_arrow_schema(schema)

    def judge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["shift"])
        n, best, since = rows[0]["n_words"], None, 0
        for i, r in enumerate(rows):
            if i + 1 == len(rows) or rows[i + 1]["shift"] - r["shift"] > max(WINDOW, n // 2):
                here, since = _covered(rows[since : i + 1]), i + 1
                best = here if best is None else max(best, here)
        if best[0] < share * n:
            return arrow.empty_table()
        one = (rows[0]["doc_id"], rows[0]["item_id"], n, best[0], best[1], -best[2])
        return pa.table([pa.array([x], t) for x, t in zip(one, arrow.types, strict=True)], schema=arrow)

    judged = met.groupBy("doc", "item").applyInArrow(judge, schema)
    # Other texts may share an identifier.
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "exact", -F.col("start"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_words", "b.covered", "b.exact", (-F.col("b.col3")).alias("start"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose own text :func:`contamination` reports.

    Rows of other texts that share a doc_id stay; a null doc_id is judged by its text like any
    other. Null and empty texts stay; an empty table stays empty, an empty benchmark removes nothing.
    """
    keyed = docs.select(identity(id_column, text_column).alias("own"), F.col(text_column).alias("text"))
    gone = contamination(keyed, benchmark, "own").select(F.col("doc_id").alias("own"))
    return without_rows(docs, gone, id_column, text_column)


@query("op8_decontamination")
def op8(spark: SparkSession, directory: str) -> DataFrame:
    return contamination(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
