"""Documents whose sets of five-word shingles overlap by 75 % or more, joined by PartEnum signatures.

Sets of sizes in one band or the next can only be similar enough when they differ in at most k
shingles. Each band therefore cuts the hashed shingle domain into m parts, m such that a set of
that size fills more than k of them: two similar sets then agree in at least ``filled - k`` filled
parts, and the content of a part is its signature. A set signs for its own band and for the one
below. The few sets that fill k parts or fewer also sign with every shingle, which any two similar
ones share. So no link is lost, whatever the hash does.

Signatures meet packed (:mod:`exchange`); a set that shares fewer than ``filled - k`` of its
signatures with anything drops them at once, which removes nearly all chance and boilerplate
meetings before a row is written. Equal sets are one vertex from there on. Similar sets share
``filled - k`` signatures and more, so each set lets go of all but one of that many, the most
frequent ones: the rarest signature that two of them share is always kept by both.

How many shingles of a set any other set has bounds every intersection it can have. That bound
drops sets and pairs before sets travel. Vertices are compared with one centre each, then those of
one signature in a star; connected components merge groups of near copies without forming their pairs, and only pairs
across components that still share a signature are compared afterwards, each once. Those are looked
for within each signature, by sketches of the sets: bits of which a pair differs in no more than its
sets differ in shingles, so that a pair becomes a row only if they leave it possible. Every link is
decided by intersecting the two sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from groundwork.llm.arrow import release, schema_with
from groundwork.llm.exchange import answers, ask, asked, buckets_of, chunked, heard, place
from groundwork.llm.links import components
from groundwork.llm.registry import query, table
from groundwork.llm.storage import identity, partitions, stored, with_summary, without_rows
from groundwork.llm.words import LOWER, U, Words, gram_hashes, mix, slices, texts_of, whole_hashes, within

SHINGLE = 5
#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Expected shingles per part at a band's smallest size; it fills more than k parts nearly always.
LOAD = 1.7
#: Rounds before the pairs that are left are formed: in the first a vertex meets one centre, then all of its stars.
ROUNDS = 3
#: Bits of a sketch per shingle, or up to twice as many.
BITS = 4
#: Bytes of sketches of one signature that are compared among themselves in one piece; more are dealt into several.
BLOCK = 4 << 20
#: Words of sketches that are compared in one step.
STRIP = 1 << 20


def bands(most: int) -> np.ndarray:
    """Smallest sizes of the bands up to ``most``: a similar set lies in the same band or the next."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // PERCENT + 1)
    return np.array(out)


def differences(low: int) -> int:
    """Most shingles in which similar sets differ, the smaller one in the band that starts at ``low``."""
    high = low * 100 // PERCENT
    return (high + high * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)


def parts(low: int) -> int:
    return max(differences(low) + 1, -int(-low // LOAD))


class Sets:
    """Distinct shingles of the texts of a table: ``values`` of row r lie in ``first[r]:first[r + 1]``."""

    def __init__(self, part: pa.Table, size: int):
        words = Words(*texts_of(part["text"]))
        h = words.hashes(LOWER)
        at = within(words.first, size)
        grams = gram_hashes(h, size)[at] if len(at) else np.empty(0, U)
        room = np.maximum(words.counts() - size + 1, 0)
        edge = np.concatenate([[0], np.cumsum(room)])
        count = words.counts()
        short = np.where((count > 0) & (count < size), count, 0)
        # Texts with fewer words are one shingle: hash them as rows of their own.
        single = np.zeros(len(count), U)
        if short.any():
            rows = np.flatnonzero(short)
            picked = np.concatenate([np.arange(words.first[r], words.first[r + 1]) for r in rows])
            single[rows] = whole_hashes(h[picked], np.concatenate([[0], np.cumsum(short[rows])]))
        found = [
            np.unique(grams[edge[r] : edge[r + 1]]) if room[r] else single[r : r + 1] if short[r] else grams[:0] for r in range(len(count))
        ]
        self.count = np.array([len(f) for f in found], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.values = np.concatenate([*found, np.empty(0, U)])

    def checks(self) -> np.ndarray:
        """A 64-bit hash of each whole set."""
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.values ^ U(0x1F83D9ABFB41BD6B)), dtype=U)])
        return mix(total[self.first[1:]] - total[self.first[:-1]] + mix(self.count.astype(U)))

    def signatures(self, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, row, slack) for the band of each set (``below`` 0) or the band under it (1).

        ``slack`` is how many signatures a set shares at least with any similar one of that band
        pair; 0 where even that is not certain, and then every shingle is a signature too.
        """
        n = self.count
        low = bands(int(n.max(initial=1)))
        band = np.searchsorted(low, n, "right") - 1 - below
        live = (n > 0) & (band >= 0)
        k = np.array([differences(int(x)) for x in low])
        m = np.array([parts(int(x)) for x in low])
        band = np.where(live, band, 0)
        width = np.where(live, m[band], 0)
        base = np.concatenate([[0], np.cumsum(width)])
        row = np.repeat(np.arange(len(n)), n)
        used = live[row]
        row, value = row[used], self.values[used]
        spread = mix(value ^ U(0x6A09E667F3BCC909))
        part = ((spread >> U(32)) * width[row].astype(U)) >> U(32)
        flat = base[row] + part.astype(np.int64)
        content = np.zeros(base[-1], U)
        np.add.at(content, flat, mix(value + U(0x3C6EF372FE94F82B)))
        filled = np.zeros(base[-1], bool)
        filled[flat] = True
        spot = np.flatnonzero(filled)
        owner = np.searchsorted(base, spot, "right") - 1
        name = band[owner].astype(U) << U(40) | (spot - base[owner]).astype(U)
        sigs = mix(content[spot] + mix(name))
        # Every set has its own size to bound the differences; k is the band's worst case.
        high = low[band] * 100 // PERCENT
        other = n * 100 // PERCENT if not below else high
        worst = np.minimum((n + other) * (100 - PERCENT) // (100 + PERCENT), k[band])
        slack = np.where(live, np.bincount(owner, minlength=len(n)) - worst, 1 << 30)
        # Both sets of a pair must be weak for it to need its shingles, so the band's k decides.
        weak = live & (np.bincount(owner, minlength=len(n)) - k[band] <= 0)
        slack = np.where(weak, 0, slack)
        more = weak[row]
        alone = mix(value[more] ^ mix(band[row[more]].astype(U) + U(0xBB67AE8584CAA73B)))
        return np.concatenate([sigs, alone]), np.concatenate([owner, row[more]]), np.maximum(slack, 0)


def _all_signatures(chunk: pa.Table, size: int) -> np.ndarray:
    out = [np.empty(0, U)]
    for part in slices(chunk, "text"):
        sets = Sets(part, size)
        out += [sets.signatures(0)[0], sets.signatures(1)[0]]
    return np.concatenate(out)


def shingle_sets(docs: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, v, met, own, own_slack, under, under_slack, shingles) of every row, written once.

    ``met`` tells whether there are signatures worth comparing: ``own`` and ``under``. They and the
    ``shingles`` are given once for equal sets of a chunk. ``v`` is a hash of the whole set.
    """
    # A bucket answers every chunk in a row of its own: half as many buckets as chunks.
    dealt, buckets = chunked(docs, id_column, text_column), partitions(docs)
    replies = answers(ask(dealt, lambda chunk: (_all_signatures(chunk, size), None), buckets))
    schema = schema_with(
        docs, {"doc_id": id_column},
        "n long, v long, met boolean, own array<long>, own_slack int, under array<long>, under_slack int, shingles array<long>",
    )
    arrow = to_arrow_schema(schema)

    def lists(values: np.ndarray, row: np.ndarray, rows: int, null_empty: bool = False) -> pa.Array:
        edges = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
        mask = pa.array(edges[1:] == edges[:-1]) if null_empty else None
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(values.view(np.int64)), mask=mask)

    def keep(chunk: pa.Table, reply: pa.Table) -> pa.Table:
        release()
        if not chunk.num_rows:
            return arrow.empty_table()
        places, _ = asked(_all_signatures(chunk, size), None, buckets)
        shared = heard(places, reply)
        out, given = [], set()
        for part in slices(chunk, "text"):
            sets, columns, both = Sets(part, size), [], []
            some = np.zeros(part.num_rows, bool)
            for below in (0, 1):
                sigs, row, slack = sets.signatures(below)
                order = np.argsort(row, kind="stable")
                sigs, row = sigs[order], row[order]
                met = shared[np.searchsorted(places, place(sigs, buckets))] if len(sigs) else np.zeros(0, bool)
                enough = np.bincount(row[met], minlength=part.num_rows) >= np.maximum(slack, 1)
                both.append((sigs, row, slack, met & enough[row]))
                some |= enough
            whole = sets.checks()
            first = some.copy()
            for r in np.flatnonzero(some).tolist():
                first[r] = whole[r] not in given
                given.add(whole[r])
            for sigs, row, slack, met in both:
                met &= first[row]
                columns += [lists(sigs[met], row[met], part.num_rows), pa.array(np.minimum(slack, 1 << 30).astype(np.int32))]
            row = np.repeat(np.arange(part.num_rows), sets.count)
            used = first[row]
            names = pa.array(whole.view(np.int64))
            columns = [part["doc_id"].combine_chunks(), pa.array(sets.count), names, pa.array(some), *columns, lists(sets.values[used], row[used], part.num_rows, True)]
            out.append(pa.table([c.cast(t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow))
        return pa.concat_tables(out)

    return stored(dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(keep, schema), "shingles")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (v, shingles) are similar enough.

    Pairs are grouped by ``a``, at most about a thousand to a group, and each group streams past
    the set of ``a``.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = with_summary(pairs, counts, "a", "n")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("b"), F.floor(F.col("n") / 1024) + 1)).select("a", "b", "salt")
    one = sets.select(F.col("v").alias("b"), "shingles")
    others = dealt.join(one, "b").select("a", "salt", "b", "shingles")
    centres = dealt.select("a", "salt").distinct().join(sets.select(F.col("v").alias("a"), "shingles"), "a")
    rows = centres.select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles").unionByName(others)
    rows = rows.repartition(partitions(pairs), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches):
        now, centre = None, None
        for batch in batches:
            a, salt, b = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
            column = batch.column("shingles")
            edges, values = column.offsets.to_numpy(), column.values.to_numpy()
            linked = []
            for i in range(batch.num_rows):
                own = values[edges[i] : edges[i + 1]]
                if b[i] is None:
                    now, centre = (a[i], salt[i]), own.copy()
                    continue
                assert now == (a[i], salt[i])
                both = len(np.intersect1d(centre, own, assume_unique=True))
                if 100 * both >= PERCENT * (len(centre) + len(own) - both):
                    linked.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(linked, pa.int64())), batch.column("b").take(pa.array(linked, pa.int64()))], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def vertices(met: DataFrame) -> DataFrame:
    """(v, n, common, shingles, own, own_slack, under, under_slack) of the distinct sets, written once.

    ``common`` counts the shingles that another of the sets has too: no intersection is larger.
    Sets in which that is under 75 % are similar to none and left out.
    """
    buckets = partitions(met)
    chunk = F.pmod(F.xxhash64("v"), F.lit(buckets_of(met))).cast("int").alias("chunk")
    signed = ("own", "own_slack", "under", "under_slack")
    dealt = met.select("v", "n", "shingles", *signed, chunk).repartition(partitions(met), "chunk")
    schema = schema_with(met, {c: c for c in ("v", "n", "shingles", *signed)}, "common long")
    arrow = to_arrow_schema(schema)

    def distinct(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        _, rows = np.unique(table["v"].to_numpy(), return_index=True)
        table = table.take(pa.array(rows)).combine_chunks()
        lists = table["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        return table, lists.flatten().to_numpy().view(U), np.diff(lists.offsets.to_numpy())

    def shingles(table: pa.Table) -> tuple[np.ndarray, None]:
        return distinct(table)[1], None

    replies = answers(ask(dealt, shingles, buckets))

    def count(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        table, values, sizes = distinct(table)
        places, _ = asked(values, None, buckets)
        shared = heard(places, reply)[np.searchsorted(places, place(values, buckets))]
        total = np.concatenate([[0], np.cumsum(shared)])
        ends = np.cumsum(sizes)
        common = total[ends] - total[ends - sizes]
        out = table.drop_columns(["chunk"]).append_column("common", pa.array(common)).select(arrow.names)
        return out.filter(pa.array(100 * common >= PERCENT * sizes)).cast(arrow)

    return stored(dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(count, schema), "sets")


def _possible(n, common, m, shared):
    """Whether sets of these sizes and bounds can be similar: 100 * least >= 75 * (n + m - least)."""
    return (100 + PERCENT) * F.least(common, shared, n, m) >= PERCENT * (n + m)


def similarity_components(sets: DataFrame) -> DataFrame:
    """(v, c) of the vertices that may have links, from the table of :func:`shingle_sets`."""
    met = sets.where("shingles IS NOT NULL")
    one = vertices(met)
    sizes = one.select("v", "n", "common")
    signed = one.select("v", "n", "common", F.explode("own").alias("sig"), F.lit(0).alias("side"), F.col("own_slack").alias("slack"))
    signed = signed.unionByName(
        one.select("v", "n", "common", F.explode("under").alias("sig"), F.lit(1).alias("side"), F.col("under_slack").alias("slack"))
    )
    spread = signed.groupBy("sig").agg(F.count("*").alias("times"), F.min("v").alias("low"), F.max("v").alias("high"), F.min("n").alias("least"))
    spread = spread.where("low <> high").select("sig", "times", "least")
    live = with_summary(signed, spread, "sig", "times")
    # The most frequent of the signatures that similar sets share go, all but one of that many.
    frequent = Window.partitionBy("v", "side").orderBy(F.desc("times"), "sig")
    live = live.withColumn("place", F.row_number().over(frequent)).where(F.col("place") >= F.col("slack"))
    # The best partner a signature can offer has as many shingles as may be common, or the fewest there are.
    best = F.greatest("least", "common")
    rows = stored(live.where(_possible(F.col("n"), F.col("common"), best, best)).select("sig", "v"), "signatures")
    tried, links, own = None, None, sizes.withColumn("c", F.col("v"))
    for turn in range(ROUNDS):
        pairs = _stars(rows, own, turn)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = stored(verified(pairs, one), "links", long_rows=True)
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        own = _labelled(sizes, components(links))
        rows = stored(_open(rows, own), "signatures")
        if rows.isEmpty():
            return own.select("v", "c")
    left = stored(rows.join(own, "v"), "open")
    drawn = stored(sketches(one.join(left.select("v").distinct(), "v", "left_semi")), "sketches", long_rows=True)
    pairs = _across(left, drawn).join(tried, ["a", "b"], "left_anti")
    found = stored(verified(stored(pairs, "pairs"), one), "links", long_rows=True)
    return _labelled(sizes, components(links.unionByName(found))).select("v", "c")


def sketches(sets: DataFrame) -> DataFrame:
    """(v, sketch) of the sets (v, shingles): each shingle turns over one of a power of two of bits.

    Shingles that both of two sets have cancel out, so their sketches differ in no more bits than the sets in shingles.
    """

    def draw(batches):
        for batch in batches:
            column, out = batch.column("shingles"), []
            edges, values = column.offsets.to_numpy(), mix(column.values.to_numpy().view(U) ^ U(0x510E527FADE682D1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                bits = max(64, 1 << (BITS * (b - a) - 1).bit_length())
                turned = np.bincount((values[a:b] & U(bits - 1)).astype(np.int64), minlength=bits) & 1
                out.append(np.packbits(turned.astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(out, pa.binary())], ["v", "sketch"])

    return sets.select("v", "shingles").mapInArrow(draw, "v long, sketch binary")


def _folded(drawn: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all as short as the shortest: a bit goes by its place modulo the length."""
    width = min(map(len, drawn)) // 8
    if not width:
        return np.empty((len(drawn), 0), U)
    return np.array([np.bitwise_xor.reduce(np.frombuffer(d, U).reshape(-1, width), axis=0) for d in drawn])


def _near(group: pa.Table) -> np.ndarray:
    """(v, c, w, d) of pairs of vertices v and w of different components c < d that may be similar, of one signature's rows."""
    group = group.sort_by("c")
    v, c, n, common, own = (group[x].to_numpy() for x in ("v", "c", "n", "common", "own"))
    if c[0] == c[-1]:
        return np.empty((0, 4), np.int64)
    drawn, apart = _folded(group["sketch"].to_pylist()), group["one"][0] != group["two"][0]
    out, step = [], max(1, STRIP // (len(v) * max(1, drawn.shape[1])))
    for lo in range(0, len(v), step):
        hi, start = min(lo + step, len(v)), int(np.searchsorted(c, c[lo], "right"))
        if start == len(v):
            break
        total = n[lo:hi, None] + n[None, start:]
        able = (c[lo:hi, None] < c[None, start:]) & ((100 + PERCENT) * np.minimum(common[lo:hi, None], common[None, start:]) >= PERCENT * total)
        if apart:
            able &= own[lo:hi, None] != own[None, start:]
        i, j = np.nonzero(able)
        differ = np.bitwise_count(drawn[lo + i] ^ drawn[start + j]).sum(axis=1, dtype=np.int64)
        close = (100 + PERCENT) * differ <= (100 - PERCENT) * total[i, j]
        i, j = lo + i[close], start + j[close]
        out.append(np.column_stack([v[i], c[i], v[j], c[j]]))
    return np.concatenate(out) if out else np.empty((0, 4), np.int64)


def _meetings(left: DataFrame, drawn: DataFrame | None = None) -> DataFrame:
    """(v, c, d, others): vertices v of component c and the ``others`` of component d that share a signature with v and may be similar.

    The rows of a signature are compared in place, by the sketches ``drawn`` if there are any. Where
    these are many bytes they are dealt into pieces, and every two pieces meet.
    """
    bytes_of = F.col("n") * BITS / 4 + 64
    spans = left.groupBy("sig").agg(F.count("*").alias("times"), (F.floor(F.sum(bytes_of) / BLOCK) + 1).alias("pieces"))
    dealt = with_summary(left, spans, "sig", "times").withColumn("own", F.pmod(F.xxhash64("v"), F.col("pieces")))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    dealt = dealt.select("sig", F.least("own", "k").alias("one"), F.greatest("own", "k").alias("two"), "own", "v", "c", "n", "common")
    dealt = dealt.withColumn("sketch", F.lit(b"")) if drawn is None else dealt.join(drawn, "v")
    key = ["sig", "one", "two"]
    dealt = dealt.repartition(partitions(left), *key).sortWithinPartitions(*key)

    def compare(batches):
        def pairs(groups: list[pa.Table]) -> pa.RecordBatch:
            found = np.unique(np.concatenate([np.empty((0, 4), np.int64), *map(_near, groups)]), axis=0)
            both = np.concatenate([found, found[:, [2, 3, 0, 1]]])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in both.T], ["v", "c", "w", "d"])

        # The last group of a batch may go on in the next one.
        held, now = [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            keys = np.column_stack([table[x].to_numpy() for x in key])
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), table.num_rows]
            groups = [table.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            if now is not None and (keys[0] == now).all():
                held.append(groups.pop(0))
            if groups:
                whole = [pa.concat_tables(held)] if held else []
                held, now = [groups.pop()], keys[-1]
                yield pairs(whole + groups)
        if held:
            yield pairs([pa.concat_tables(held)])

    met = dealt.mapInArrow(compare, "v long, c long, w long, d long")
    return met.groupBy("v", "c", "d").agg(F.collect_set("w").alias("others"))


def _across(left: DataFrame, drawn: DataFrame | None = None) -> DataFrame:
    """Possible pairs of vertices of different components that share a signature, each once."""
    return _meetings(left, drawn).select(F.col("v").alias("a"), F.explode("others").alias("b")).where("a < b")


def _stars(rows: DataFrame, own: DataFrame, turn: int) -> DataFrame:
    """Possible pairs of a centre per signature with its vertices of other components.

    The first centre is the set with the fewest shingles of its own, then chance decides. In the first turn a vertex
    meets the best of its centres alone, so that a large group of near copies is one component, or nearly, before
    a vertex meets all of them.
    """
    known = rows.join(own, "v")
    rank = F.col("common") - F.col("n") if turn < ROUNDS - 1 else F.lit(0)
    order = F.struct((-rank).alias("r"), F.xxhash64(F.lit(turn), "v").alias("o"), "v", "c", "n", "common")
    centre = known.groupBy("sig").agg(F.min(order).alias("x"), F.count("*").alias("times"))
    centre = centre.select("sig", "times", *(F.col(f"x.{c}").alias(f"its_{c}") for c in ("v", "c", "n", "common")))
    met = with_summary(known, centre, "sig", "times").where(F.col("c") != F.col("its_c"))
    met = met.where(_possible(F.col("n"), F.col("common"), F.col("its_n"), F.col("its_common")))
    if turn == 0:
        met = met.groupBy("v").agg(F.min(F.struct((F.col("its_n") - F.col("its_common")).alias("own"), F.xxhash64("its_v").alias("o"), "its_v")).alias("x")).select("v", "x.its_v")
    return met.select(F.least("its_v", "v").alias("a"), F.greatest("its_v", "v").alias("b")).distinct()


def _open(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Rows of the signatures that still span several components."""
    known = rows.join(own, "v")
    spans = known.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("times")).where("low <> high")
    return with_summary(rows, spans.select("sig", "times"), "sig", "times").select("sig", "v")


def _labelled(sizes: DataFrame, found: DataFrame) -> DataFrame:
    return stored(sizes.join(found, "v", "left").withColumn("c", F.coalesce("c", "v")), "labels")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, a set holds the distinct ``size``-word
    shingles of the whole text; fewer words are one shingle, no words or a null text the empty set,
    which links with nothing. Sets link when 100 * intersection >= 75 * union. ``component_id`` is
    the smallest doc_id reachable by links; null identifiers count only where there is no other.
    Repeated rows have equal sets and share a component. Shingles are compared as 64-bit hashes.
    An empty table gives no rows. Other columns are not looked at.
    """
    sets = shingle_sets(docs, size, id_column, text_column)
    labels = similarity_components(sets)
    narrow = sets.select("doc_id", "n", "v", "met")
    # A set that is similar to no other is still the set of all its copies.
    met = narrow.where("met").join(labels, "v", "left").select("doc_id", "n", F.coalesce("c", "v").alias("c"))
    met = stored(met, "members")
    least = stored(met.groupBy("c").agg(F.min("doc_id").alias("component_id")), "least")
    joined = met.join(least, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = narrow.where("NOT met").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(rest)


def without_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs``, all columns, with one identifier and text of each component: the smallest doc_id, and of
    texts that share it the one with the smallest SHA-256.

    A null doc_id stays only where the component has no other. Rows that repeat an identifier and a
    text are one document and all stay or all go (:func:`without_copies` tells them apart). Empty
    texts are linked with nothing and stay; an empty table stays empty.
    """
    keyed = docs.select(identity(id_column, text_column).alias("own"), F.col(text_column).alias("text"))
    found = jaccard_components(keyed, SHINGLE, "own", "text")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("own"))
    return without_rows(docs, gone, id_column, text_column)


@query("op1_jaccard_join")
def op1(spark: SparkSession, directory: str) -> DataFrame:
    return jaccard_components(table(spark, directory, "documents"))
