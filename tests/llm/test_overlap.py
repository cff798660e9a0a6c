"""Jaccard join and substring dedup against brute force, and the pipeline."""

import re
from collections import defaultdict

import numpy as np
import pytest

from groundwork.llm import jaccard_join
from groundwork.llm.jaccard_join import bands, differences, jaccard_components, parts, without_near_copies
from groundwork.llm.links import components
from groundwork.llm.substring_dedup import substring_dedup
from groundwork.llm.words import SPACED, Words, gram_hashes, whole_hashes
from tests.llm.conftest import prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def linked(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [(n, shingles(t)) for n, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (n, _) in enumerate(sets):
        least[root(i)].append(n)
    return sorted(((n, len(s), min((x for x in least[root(i)] if x is not None), default=None)) for i, (n, s) in enumerate(sets)), key=repr)


def edited(text, seed, share):
    """Some words replaced, so that similarity lies around the threshold."""
    rng = np.random.default_rng(seed)
    return " ".join(w if rng.random() > share else f"e{seed}x{i}" for i, w in enumerate(text.split()))


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_components_match_all_pairs(frame):
    rows, n = [], 0
    for base in range(24):
        text = prose(base, [4, 5, 6, 9, 14, 40, 120, 300][base % 8], 5000)
        for k, share in enumerate([0, 0, 0.01, 0.02, 0.03, 0.05, 0.08]):
            n += 7
            rows.append((n % 1009, edited(text, 100 * base + k, share)))
    # Prefixes and extensions, where sizes differ as much as similar sets may.
    for size in range(5, 60, 3):
        rows += [(2000 + size, prose(77, size, 5000)), (3000 + size, prose(77, size, 5000) + f" q{size}")]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "One TWO"), (5004, "one two"), (None, "one two"), (None, "alone here"), (5003, "One TWO")]
    assert found(jaccard_components(frame(rows))) == linked(rows)


def test_large_groups_and_boilerplate(frame, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    line = prose(1, 9, 5000)
    rows = [(i, f"{line} {prose(100 + i, 15 + i % 30, 5000)}") for i in range(120)]
    text = prose(2, 150, 5000)
    rows += [(1000 + i, edited(text, i, 0.012)) for i in range(90)]
    rows += [(2000 + i, edited(text, 5000 + i, 0.05)) for i in range(40)]
    rows += [(3000 + i, text) for i in range(60)]
    assert found(jaccard_components(frame(rows))) == linked(rows)


def test_links_across_a_band_edge_beside_shorter_variants(frame):
    rows = []
    for group in range(6):
        whole = prose(40 + group, 164, 5000).split()
        own = whole[:142]
        # Sets of 160, 138 and 117 shingles: the first is linked with the second only.
        variants = [own[:p] + own[p + 21 :] for p in range(0, 120, 4)]
        rows += [(1000 * group + i, " ".join(w)) for i, w in enumerate([own, *variants, whole])]
    want = linked(rows)
    assert {c for _, _, c in want} == {1000 * group for group in range(6)}
    assert found(jaccard_components(frame(rows))) == want


def test_long_text_and_empty_table(frame):
    long = prose(5, 120_000, 50_000)
    rows = [(2, long), (1, long + " tail"), (3, prose(6, 100))]
    assert [(r[0], r[2]) for r in found(jaccard_components(frame(rows)))] == [(1, 1), (2, 1), (3, 3)]
    assert found(jaccard_components(frame([]))) == []


@pytest.mark.parametrize("a", [*range(1, 200), 997, 5000])
def test_bands_hold_every_similar_size(a):
    low = bands(20_000)
    i = int(np.searchsorted(low, a, "right")) - 1
    for b in {a, a + 1, (a + a * 100 // 75) // 2, a * 100 // 75}:
        j = int(np.searchsorted(low, b, "right")) - 1
        assert b * 75 > a * 100 or (j - i in (0, 1) and (a + b) * 25 // 175 <= differences(int(low[i])) < parts(int(low[i])))


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)], "a long, b long")
    labels = {r.v: r.c for r in components(links).collect()}
    assert labels == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}


def removed(rows, size):
    first = {}
    words = [(n, WORDS.findall(t or "")) for n, t in rows]
    order = [(float("inf") if n is None else n, w) for n, w in words]
    for n, w in order:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(n, first.get(key, n))
    out = []
    for (name, w), (n, _) in zip(words, order, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < n:
                gone[i : i + size] = [True] * size
        out.append((name, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [50, 7])
def test_passages_match_brute_force(frame, size):
    shared = [prose(900 + k, n, 9000) for k, n in enumerate([49, 50, 51, 74, 75, 130])]
    rows = []
    for i in range(60):
        parts = [prose(i, 3 + i, 9000), shared[i % 6], prose(300 + i, 5, 9000), shared[(i * 5 + 1) % 6]]
        rows.append(((i * 37) % 101, "\n".join(parts)))
    rows += [(200, rows[0][1]), (201, "r " * 400), (202, "r " * 120), (203, None), (204, ""), (None, shared[5]), (None, shared[5])]
    rows += [(0, shared[5]), (5, shared[5]), (205, prose(1, 20_000, 9000)), (206, prose(1, 20_000, 9000))]
    got = substring_dedup(frame(rows), size).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == removed(rows, size)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


def test_substring_dedup_of_nothing(frame):
    assert substring_dedup(frame([])).collect() == []
    with pytest.raises(ValueError):
        substring_dedup(frame([]), 1)


def test_words_and_hashes_match_plain_python():
    texts = ["", " a  b\tc ", "é à b", "one", "x " * 3000, "\n", "tail"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    words = Words(np.frombuffer(b"".join(data), np.uint8), offsets, SPACED)
    whole = b"".join(data)
    found = [[whole[a:b].decode() for a, b in zip(words.starts[f:t], words.ends[f:t], strict=True)] for f, t in zip(words.first[:-1], words.first[1:], strict=True)]
    assert found == [WORDS.findall(t) for t in texts]
    h = words.hashes()
    names = [w for f in found for w in f]
    assert len({(w, int(x)) for w, x in zip(names, h, strict=True)}) == len(set(names)) == len(set(h.tolist()))
    three = h[words.first[1] : words.first[2]]
    assert whole_hashes(three, np.array([0, 3]))[0] == gram_hashes(three, 3)[0]


def test_pipeline_stages_agree_with_their_operators(spark):
    import corpus_pipeline
    from groundwork.llm.exact_dedup import exact_dedup
    from groundwork.llm.toxicity import fit, score_toxicity
    from tests.conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, SMALL)
    model = fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert ids(clean) == ids(score_toxicity(docs, model).where("predicted = 0"))
    assert ids(stage["exact_dedup"](spark, docs, SMALL)) == ids(exact_dedup(docs, keep="largest").where("kept"))
    assert ids(stage["jaccard_join"](spark, docs, SMALL)) == sorted(n for n, _, c in linked([(r.doc_id, r.text) for r in docs.collect()]) if n == c)
    for name in list(stage)[:-1]:
        assert stage[name](spark, docs, SMALL).columns == docs.columns
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert packed and {r.doc_id for r in packed} <= set(ids(docs))


def test_near_copies_go_by_row(frame, monkeypatch):
    from groundwork.llm import storage

    text = prose(91, 200)
    near, other = text + " more", prose(92, 200)
    rows = [(1, text), (5, near), (5, other), (None, text + " end"), (None, prose(93, 80)), (7, None), (8, ""), (9, "")]
    want = sorted([rows[0], rows[2], *rows[4:]], key=repr)

    def left():
        found = without_near_copies(frame(rows))
        assert found.columns == frame(rows).columns
        return sorted(((r.doc_id, r.text) for r in found.collect()), key=repr)

    assert left() == want
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    assert left() == want
    assert without_near_copies(frame([])).collect() == []


def test_vertices_and_components_meet_under_few_of_their_signatures(spark):
    pick = np.random.default_rng(4)
    # 20 vertices, two to a component, with 60 of 80 signatures each, and a loner with one that another has.
    held = {v: set(pick.choice(80, 60, replace=False).tolist()) for v in range(20)} | {20: {79, 500}}
    held[3].add(500)
    rows = [(sig - 40, v, v // 2, 100, 100) for v in held for sig in held[v]]
    left = spark.createDataFrame(rows, "sig long, v long, c long, n long, common long")
    met = [tuple(r) for r in jaccard_join._meetings(left).select("v", "d").collect()]
    assert set(met) == {(v, w // 2) for v in held for w in held if v // 2 != w // 2 and held[v] & held[w]}
    assert len(met) < 1.5 * len(set(met))  # under every signature they share there are some fifty times as many
    pairs = [tuple(r) for r in jaccard_join._across(left).collect()]
    assert len(pairs) == len(set(pairs)) and {(v, w) for v in held for w in held if v < w and v // 2 != w // 2 and held[v] & held[w]} <= set(pairs)


def test_in_the_first_turn_a_vertex_meets_one_centre(spark):
    rows = spark.createDataFrame([(sig, v) for sig in range(30) for v in range(40) if (sig + v) % 3], "sig long, v long")
    own = spark.createDataFrame([(v, 100, 90 + v % 10, v) for v in range(40)], "v long, n long, common long, c long")
    first = jaccard_join._stars(rows, own, 0)
    assert first.count() <= 40
    assert {v for r in first.collect() for v in r} == set(range(40))


def test_outsiders_of_a_large_group_do_not_meet_all_its_members(frame, monkeypatch):
    text, compared, real = prose(8, 160, 5000), [], jaccard_join.verified

    def counted(pairs, sets):
        compared.append(pairs.count())
        return real(pairs, sets)

    monkeypatch.setattr(jaccard_join, "verified", counted)

    def replaced(seed, words):
        # From a few words, so that what is new in one text is in others too.
        pick, out = np.random.default_rng(seed), text.split()
        for at in pick.choice(160, words, replace=False).tolist():
            out[at] = f"new{at}x{pick.integers(3)}"
        return " ".join(out)

    rows = [(i, replaced(i, 1 + i % 3)) for i in range(150)] + [(1000 + i, replaced(5000 + i, 8)) for i in range(80)]
    want = linked(rows)
    assert sum(c == 0 for _, _, c in want) > 120 and sum(n == c for n, _, c in want) > 40
    assert found(jaccard_components(frame(rows))) == want
    assert len(compared) < 4 or compared[-1] < 3 * len(rows)


@pytest.mark.parametrize("block", [4 << 20, 1500])
def test_sketches_leave_every_similar_pair(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    pick = np.random.default_rng(6)
    held = []
    for size in (1, 3, 9, 64, 100, 129, 900):
        whole = pick.integers(-(1 << 62), 1 << 62, size)
        for share in (0, 0.05, 0.1, 0.14, 0.15, 0.2, 0.3, 0.4):
            changed = np.where(pick.random(size) < share, pick.integers(-(1 << 62), 1 << 62, size), whole)
            held.append(np.unique(changed[: len(changed) - len(changed) * int(10 * share) // 20]).tolist() or [1])
    sets = spark.createDataFrame([(v, h) for v, h in enumerate(held)], "v long, shingles array<long>")
    # Two to a component, all under two signatures.
    left = spark.createDataFrame([(sig, v, v // 2, len(h), len(h)) for sig in (3, -4) for v, h in enumerate(held)], "sig long, v long, c long, n long, common long")
    pairs = [tuple(r) for r in jaccard_join._across(left, jaccard_join.sketches(sets)).collect()]
    least = {(v, w): 2 * len(set(h) & set(held[w])) / (len(h) + len(held[w])) for v, h in enumerate(held) for w in range(v + 1, len(held)) if v // 2 != w // 2}
    assert len(pairs) == len(set(pairs)) and {p for p, x in least.items() if x >= 6 / 7} <= set(pairs) <= set(least)
    assert len(pairs) < len(least) / 4
