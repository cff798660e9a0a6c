"""Licences, toxicity, tokens, packing and decontamination against plain Python."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwork.llm.arrow import worker_state
from groundwork.llm.decontamination import contamination, without_contaminated
from groundwork.llm.licenses import BASE, evaluate, leading_expression, scan_licenses, to_postfix
from groundwork.llm.packing import brute_force, curve_keys, digest, hilbert_keys, pack_documents
from groundwork.llm.storage import BATCH_BYTES, small_batches, stored
from groundwork.llm.token_counts import count_tokens
from groundwork.llm.tokens import Encoder, default_vocabulary
from groundwork.llm.toxicity import fit, score_toxicity, without_toxic
from tests.conftest import SMALL
from tests.llm.conftest import prose

ODD = [(1, None), (2, ""), (3, "  two  spaces   and\ttabs \n\n x"), (4, "é à ö  ñ"), (5, "a" * 100_000), (6, "don't  　 stop <|endoftext|>"), (None, "no id"), (3, "other text")]


def test_postfix_order_and_verdicts():
    assert to_postfix("MIT OR Apache-2.0 AND (GPL-3.0 WITH GCC-exception-3.1)") == [
        "mit", "apache-2.0", "gpl-3.0", "gcc-exception-3.1", "with", "and", "or",
    ]
    assert evaluate("GPL-3.0-only OR MIT")[1] is True
    assert evaluate("GPL-3.0-only AND MIT")[1] is False
    assert evaluate("GPL-2.0-only WITH Classpath-exception-2.0")[1] is True
    assert evaluate("(GPL-2.0-only OR MIT) AND ISC") == (frozenset({"gpl-2.0-only", "mit", "isc"}), True)
    for bad in ("", "OR MIT", "MIT OR", "(MIT", "MIT)", "MIT ISC", "()", "(MIT OR ISC) WITH x"):
        assert evaluate(bad) is None
    assert leading_expression(" MIT OR ISC */ rest") == "mit or isc"
    for text, said in [
        (" (MIT) and more words", "( mit )"), ("***", ""), (" MIT, see LICENSE", "mit"), (" see the file LICENSE", ""),
        (" Apache-2.0.", "apache-2.0"), (" MIT. OR ISC", "mit"), ("MIT-->", "mit"), (' "MIT"', "mit"), (" MIT\nOR ISC", "mit"),
        (" GPL-2.0-only WITH nothing", "gpl-2.0-only"), (" GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", "gpl-2.0-only with classpath-exception-2.0 and mit"),
        (" (MIT OR GPL-2.0+) AND LicenseRef-own", "( mit or gpl-2.0+ ) and licenseref-own"), ("((MIT)", ""), (" MIT AND (ISC OR", "mit"),
        ("(MIT OR ISC) WITH llvm-exception", "( mit or isc )"),
    ]:
        assert leading_expression(text) == said
        assert not said or evaluate(said)


def base_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_time_grows_with_the_hits_of_a_text(frame):
    from time import perf_counter

    def seconds(times):
        rows = frame([(1, "mit license " * times)], 1)
        scan_licenses(rows).select("n_base").collect()
        start = perf_counter()
        assert scan_licenses(rows).select("n_base").first()[0] == times
        return perf_counter() - start

    assert seconds(160_000) < 8 * seconds(20_000) + 2


def test_base_phrases_match_brute_force(frame):
    rows = ODD + [
        (10, "MIT License. mit\nLICENSE! mit-license, mitlicense mit é license"),
        (11, "gnu general public license cc by cc by-nc apache license version 2.0"),
        (12, "mit license " * 20_000),
        (13, "x\n// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND ISC\ny"),
        (14, "SPDX-License-Identifier: AND"),
        (15, "SPDX-License-Identifier: MIT, see LICENSE"),
        (16, "SPDX-License-Identifier: see the file LICENSE"),
        (17, "SPDX-License-Identifier: Apache-2.0. SPDX-License-Identifier: (MIT) and more words"),
    ]
    found = scan_licenses(frame(rows)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=repr)
    assert got == sorted(((n, *base_of(t)) for n, t in rows), key=repr)
    by_id = {r.doc_id: r for r in found}
    assert by_id[13].labels == "gpl-2.0-only,isc,mit"
    assert by_id[13].expressions[0].accepted is True
    assert (by_id[14].labels, by_id[14].expressions) == ("", [])
    assert [by_id[n].labels for n in (15, 16, 17)] == ["mit", "", "apache-2.0,mit"]
    for r in found:
        if r.doc_id == 12:
            assert [h.word for h in r.notices] == list(range(0, 40_000, 2))
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)
    assert scan_licenses(frame([])).collect() == []


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_vocabulary())


def test_pieces_give_the_ids_of_the_whole(encoder):
    texts = [t or "" for _, t in ODD] + ["a  b   c \n d  e f  ", " lead", "x \u0085 y\x1c z", "l'été 12 345,6 km", "\n \n  \n", "a​ b"]
    texts += [prose(i, 200) for i in range(5)]
    for text in texts:
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), encoder.dtype).tolist() == whole
        assert encoder.lengths()[whole].sum() == len(text.encode())


def test_added_tokens_are_encoded_as_by_a_fresh_tokenizer(encoder):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(default_vocabulary())
    texts = ["<|endoftext|>", "one <|endoftext|> two", "don't<|endoftext|><|endoftext|>  é stop", "a <|endoftext| > b"]
    for text in texts:
        ids = np.frombuffer(encoder.ids(text), encoder.dtype).tolist()
        assert ids == fresh.encode(text, add_special_tokens=False).ids
        assert encoder.lengths()[ids].sum() == len(text.encode())


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
    assert curve_keys(np.empty(0, np.uint16), np.zeros(1, np.int64), np.ones((4, 3), np.int64)).shape == (1,)


def packed(found, length):
    """Checks that hold for every packing; {(doc_id): [(start, ids)]}."""
    docs, places = defaultdict(list), defaultdict(list)
    for r in found:
        assert len(r.ids) == 4 * r.length > 0
        docs[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    full = [sum(s for _, s in p) for _, p in sorted(places.items())]
    assert sorted(places) == list(range(len(places))) and all(f == length for f in full[:-1])
    return docs


def test_packing_is_a_round_trip(frame):
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(100 + i, prose(i % 7, 30 + 11 * i)) for i in range(60)] + [(300 + i, "same") for i in range(500)]
    docs = packed(pack_documents(frame(rows), length=256).collect(), 256)
    want = brute_force(rows, default_vocabulary())
    assert set(docs) == set(want)
    for name, parts in docs.items():
        parts.sort()
        whole = b"".join(ids for _, ids, _ in parts)
        assert (len(whole) // 4, zlib.crc32(whole)) == want[name]
        assert {n for *_, n in parts} == {want[name][0]}


def test_packing_does_not_depend_on_partitions(frame):
    rows = [(i, prose(i, 40)) for i in range(40)] + [(7, "twin"), (7, "twin"), (None, None)]
    one, many = (sorted(map(repr, pack_documents(frame(rows, p)).collect())) for p in (1, 5))
    assert one == many
    assert pack_documents(frame([])).collect() == []
    digests = [r.asDict() for r in digest(pack_documents(frame(rows))).collect()]
    assert sum(d["doc_id"] is None for d in digests) == 1 and all(0 <= d["ids_crc32"] < 2**32 for d in digests)
    assert digest(pack_documents(frame([]))).collect() == []


def test_tokens_of_lines_match_offsets(frame, encoder):
    rows = ODD + [(20, "one\ntwo\n\n\nthree \n four\n"), (21, prose(3, 2000))]
    found = defaultdict(int)
    for r in count_tokens(frame(rows)).collect():
        found[r.doc_id, r.section] += r.n_tokens
    want, lengths = defaultdict(int), encoder.lengths()
    for name, text in rows:
        data, at = (text or "").encode(), 0
        edges = [0]
        edges += [i + 1 for i, b in enumerate(data) if b == 10]
        for i in range(len(edges)):
            want[name, i] = want[name, i]
        for token in encoder.tokenizer.encode(text or "", add_special_tokens=False).ids:
            stop = at + int(lengths[token])
            share = [min(stop, b) - max(at, a) for a, b in zip(edges, [*edges[1:], len(data)], strict=True)]
            want[name, share.index(max(share))] += 1
            at = stop
    assert found == want


def test_tokens_of_given_sections(spark):
    schema = "doc_id long, text string, parts array<struct<name: string, start: long, stop: long>>"
    text = "Title here\nbody of words and more"
    parts = [("title", 0, 10), ("body", 11, 33), ("late", 20, 25), (None, 40, 30), ("void", None, 3)]
    docs = spark.createDataFrame([(1, text, parts), (2, text, None), (3, None, [("a", 0, 0)])], schema)
    found = {(r.doc_id, r.name): (r.start, r.stop, r.n_tokens) for r in count_tokens(docs, "parts").collect()}
    assert found[1, "title"][:2] == (0, 10) and found[1, "body"][:2] == (11, 20) and found[1, "late"][:2] == (20, 25)
    whole = sum(n for (d, _), (*_, n) in found.items() if d == 1)
    assert whole == found[2, None][2] and found[3, "a"][2] == 0
    assert count_tokens(docs.where("false"), "parts").collect() == count_tokens(docs.where("false")).collect() == []


ITEMS = [
    (1, "A train leaves the old station with 120 people and stops 3 times before it reaches the valley in 45 minutes"),
    (2, "Alice gave 5 apples to Bob and then Alice asked what Bob would do with 5 apples on a rainy day"),
    (3, "too short"), (4, None), (5, "one two three four five six"), (1, "A train leaves the old station with 120 people and stops 3 times before it reaches the valley in 45 minutes"),
]


def test_templates_find_reparameterised_items(frame, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    noise = prose(1, 60)
    rows = [
        (1, f"{noise} {ITEMS[0][1]} {noise}"),
        (2, f"{noise}. A train leaves the old station with 340 people and stops 7 times before it reaches the valley in 90 minutes. {noise}"),
        (3, f"{noise} Carol gave 9 apples to Dave and then Carol asked what Dave would do with 9 apples on a rainy day"),
        (4, f"{noise} Carol gave 9 apples to Dave and then Erin asked what Frank would do with 8 apples on a rainy day"),
        (5, noise), (6, None), (7, ""), (None, ITEMS[0][1].upper()), (8, "x ONE, two - three four five six x"),
        (9, " ".join(ITEMS[0][1].split()[:6])), (10, f"{noise} " * 300 + ITEMS[1][1]), (1, f"{noise} {ITEMS[0][1]} {noise}"),
    ]
    for block in (2_000_000, 7):
        found = {(r.doc_id, r.item_id): r for r in contamination(frame(rows), items, block=block).collect()}
        assert set(found) == {(1, 1), (2, 1), (3, 2), (None, 1), (8, 5), (10, 2)}
    assert found[1, 1].exact == found[1, 1].n_words and found[1, 1].start == 60
    assert found[2, 1].exact < found[2, 1].covered == found[2, 1].n_words
    assert contamination(frame([]), items).collect() == []
    assert contamination(frame(rows), items.limit(0)).collect() == []
    left = without_contaminated(frame(rows), items)
    assert sorted((r.doc_id or 0) for r in left.collect()) == [4, 5, 6, 7, 9]


def test_shifted_copies_are_read_together(frame, spark):
    whole = prose(11, 39, 5000).split()
    shifted = " ".join([*whole[:13], "extra", *whole[13:26], "more", *whole[26:]])
    ask = "When Ann counts the coins in her box she finds {} of them and gives {} to {} before they leave the market"
    items = spark.createDataFrame([(1, " ".join(whole)), (2, ask.format(12, 7, "Bob"))], "item_id long, text string")
    noise = prose(12, 60, 5000)
    rows = [(1, f"{noise} {shifted} {noise}"), (2, f"{noise} {ask.format('1,250', '2.5', 'Mary Jane')} {noise}"), (3, noise)]
    found = {(r.doc_id, r.item_id): r for r in contamination(frame(rows), items).collect()}
    assert set(found) == {(1, 1), (2, 2)}
    assert found[1, 1].covered == found[1, 1].exact == 39
    assert found[2, 2].covered == found[2, 2].n_words


def test_dense_slots_clashes_and_short_items(frame, spark):
    ask = "the farmer sold {} old sheep and {} young goats then bought {} brown hens for the empty barn"
    dense = "in the town market hall we met Ann, 3, Bob, 4, Carl, 5, Dora, 6, Emil, 7, Fay, 8, Gus, 9"
    other = "in the town market hall we met Hal, 13, Ida, 14, Jon, 15, Kim, 16, Lea, 17, Max, 18, Ned, 19"
    items = spark.createDataFrame([(1, ask.format(3, 5, 3)), (2, dense), (3, "blue moon tide")], "item_id long, text string")
    noise = prose(13, 60, 5000)
    rows = [
        (1, f"{noise} {ask.format(4, 4, 4)} {noise}"), (2, f"{noise} {ask.format(4, 6, 7)} {noise}"), (3, f"{noise} {other} {noise}"),
        (4, f"{noise} Blue moon, tide {noise}"), (5, f"{noise} blue tide moon"), (6, f"{noise} Hal, 13, Ida, 14, Jon, 15, Kim, 16, Lea, 17, Max, 18 {noise}"),
    ]
    for block in (2_000_000, 7):
        assert {(r.doc_id, r.item_id) for r in contamination(frame(rows), items, block=block).collect()} == {(1, 1), (2, 1), (3, 2), (4, 3)}


def test_leaked_items_of_the_given_tables(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))

    def plain(text):
        return " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "

    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    want = {(d, i.item_id) for i in items.collect() for d, t in texts.items() if plain(i.text) in t}
    assert want and want == {(r.doc_id, r.item_id) for r in contamination(docs, items).collect()}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    model = fit(docs, labels)
    scored = score_toxicity(docs, model).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    toxic, ordinary = ([r for r in held if r.toxic == k] for k in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in ordinary) <= 0.03 * len(ordinary)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    kept = without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in scored)


def test_toxicity_takes_odd_texts_and_missing_labels(frame, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [*ODD, (1, None)]
    assert {r.score for r in score_toxicity(frame(rows), fit(frame(rows), none)).collect()} == {0.0}
    one_sided = spark.createDataFrame([(i, 1) for i in range(8)] + [(None, 0), (3, None)], "doc_id long, toxic int")
    assert {r.predicted for r in score_toxicity(frame(rows), fit(frame(rows), one_sided)).collect()} == {1}
    texts = [(i, f"{prose(i, 30)} {'horrid vile' if i % 3 == 0 else 'mild'} {prose(i + 1, 30)}") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(0, 1), (0, None)], "doc_id long, toxic int")
    model = fit(frame(texts), labels)
    found = score_toxicity(frame(texts + rows), model).collect()
    assert len(found) == len(texts) + len(rows)
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in found if r.doc_id is not None and r.doc_id > 10]) > 0.95
    assert score_toxicity(frame([]), model).collect() == []


def test_scores_against_plain_compression(frame, spark):
    import math

    import zstandard as zs

    from groundwork.llm.toxicity import FILLER

    long = "x" * 300
    texts = [(i, f"{prose(i, 30)} {('Horrid, ' + long) if i % 3 == 0 else 'mild'} {prose(i + 1, i % 40)}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = fit(frame(texts), labels)
    assert any(long[:40].encode() in half.toxic for half in model.halves)
    shape = dict(
        window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=16, strategy=zs.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )

    def size(dictionary, word):
        window = b" " + word + b" " + FILLER
        return min(255, len(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(dictionary), compression_params=zs.ZstdCompressionParameters(**shape)).compress(window)))

    def score(text):
        words, total = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()), 0
        for half in model.halves:
            gains = []
            for word in {w.encode() for w in words}:
                gains.append(half.weights.get(min(len(word), 15) << 16 | size(half.ordinary, word) << 8 | size(half.toxic, word), 0.0))
            best = [max(g, 0) for g in sorted(gains)[::-1][:3]]
            x = best + [0] * (3 - len(best)) + [math.log(1 + len(words)), sum(g > 1 for g in gains) / (len(words) + 20) ** 0.5]
            mean, spread, w = half.curve
            total += 1 / (1 + math.exp(-max(-30, min(30, w[0] + sum(c * (v - m) / s for c, v, m, s in zip(w[1:], x, mean, spread))))))
        return total / 2

    rows = [*texts[:25], (-1, None), (-2, ""), (-3, long), (-4, "horrid"), (-4, "horrid")]
    got = [(r.doc_id, r.score) for r in score_toxicity(frame(rows), model).collect()]
    want = [(i, score(t or "")) for i, t in rows]
    assert [i for i, _ in sorted(got)] == [i for i, _ in sorted(want)]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(sorted(got), sorted(want), strict=True))


def test_order_of_words_alone_removes_nothing(frame, spark):
    # No word tells the classes apart: every third text is toxic by the order of its words.
    words = prose(5, 12).split()
    rows = [(i, " ".join(sorted(words, reverse=i % 3 == 0)) + f" {i % 7}") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = fit(frame(rows), labels)
    assert model.halves == [] and 0.2 < model.base < 0.45
    assert without_toxic(frame(rows), model).count() == 600
    assert {r.score for r in score_toxicity(frame(rows), model).collect()} == {model.base}


def test_share_of_the_labels_is_the_score_without_a_model(frame, spark):
    labels = spark.createDataFrame([(i, int(i < 50)) for i in range(1000)], "doc_id long, toxic int")
    model = fit(frame([(i, "same words") for i in range(1000)]), labels, sample=40)
    assert model.halves == [] and abs(model.base - 0.05) < 0.03
    assert fit(frame([]), labels).halves == [] and without_toxic(frame([]), model).collect() == []


def test_missing_identifier_is_not_held_out(spark):
    from groundwork.llm.toxicity import held_out

    got = spark.createDataFrame([(None,), (1,)], "doc_id long").select(held_out().alias("h")).collect()
    assert [r.h for r in got] == [False, zlib.crc32(b"1") % 4 == 2]


def test_rows_are_told_apart_by_identifier_and_text(frame, spark):
    item = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old tree by the river"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item), (1, "clean words that share the identifier"), (None, "here: " + item), (None, None), (2, ""), (3, item), (3, item)]
    left = sorted(((r.doc_id, r.text) for r in without_contaminated(frame(rows), benchmark).collect()), key=repr)
    assert left == sorted([rows[1], rows[3], rows[4]], key=repr)
    assert without_contaminated(frame([]), benchmark).collect() == []
    assert without_contaminated(frame(rows), benchmark.where("false")).count() == len(rows)


def _handed_over(monkeypatch, docs):
    """The functions that are given to mapInArrow from now on."""
    seen, kind = [], type(docs)
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, work, *a, **b: (seen.append(work), own(self, work, *a, **b))[1])
    return seen


def test_long_rows_reach_workers_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "rows"])

    long = spark.range(0, 4000, 1, 1).select(F.repeat(F.col("id").cast("string"), 2000).alias("text"))
    found = stored(long.mapInArrow(sizes, "bytes long, rows long"), "batches", long_rows=True).collect()
    assert sum(r["rows"] for r in found) == 4000
    assert max(r["bytes"] for r in found) < 6 << 20 < sum(r["bytes"] for r in found)
    assert spark.conf.get(BATCH_BYTES, None) is None
    spark.conf.set(BATCH_BYTES, "1m")
    try:
        with small_batches(spark):
            assert spark.conf.get(BATCH_BYTES) == "1m"
        assert spark.conf.get(BATCH_BYTES) == "1m"
    finally:
        spark.conf.unset(BATCH_BYTES)


def test_packing_lets_the_encoder_go_before_it_cuts(frame, monkeypatch):
    docs = frame([(i, prose(i, 30)) for i in range(20)])
    seen = _handed_over(monkeypatch, docs)
    pack_documents(docs)
    worker_state("encoders")["path"] = "an encoder"
    assert not list(seen[-1](iter([])))
    assert not worker_state("encoders")


def test_windows_are_looked_up_in_bounded_memory(frame, monkeypatch):
    import tracemalloc

    docs, items = frame([(1, prose(1, 40))]), frame([(9, prose(1, 40))])
    seen = _handed_over(monkeypatch, docs)
    assert contamination(docs, items, item_id_column="doc_id").count() == 1
    lookup = seen[1]
    many = pa.table({"doc_id": pa.array(range(400), pa.int64()), "text": [prose(i, 5000) for i in range(400)], "doc": pa.array(range(400), pa.int64())})
    assert many.nbytes > 6 << 20
    tracemalloc.start()
    try:
        list(lookup(iter(many.combine_chunks().to_batches())))
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()
