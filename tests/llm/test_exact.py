"""Exact dedup, sharding and line dedup against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from groundwork.llm.bins import CapacityTree, best_fit_decreasing, best_fit_into
from groundwork.llm.exact_dedup import exact_dedup, without_copies
from groundwork.llm.line_dedup import FEW, line_dedup, site_spread
from groundwork.llm.sharding import shard_documents
from tests.conftest import plan_of
from tests.llm.conftest import prose

ROWS = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "A b"), (6, "a b "), (7, "x" * 300_000), (8, "x" * 300_000), (None, "a b"), (9, "ünï")]


def copies(rows, keep):
    groups = defaultdict(list)
    for name, text in rows:
        groups[text or ""].append(name)
    best = {}
    for text, names in groups.items():
        known = [n for n in names if n is not None]
        best[text] = (max if keep == "largest" else min)(known, default=None)
    return sorted(
        ((n, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for n, t in rows), key=repr
    )


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("fan_in", [2, 16])
def test_copies_match_brute_force(frame, keep, fan_in):
    rows = ROWS + [(100 + i, "hot") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(50)]
    found = exact_dedup(frame(rows, 7), keep=keep, fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == copies(rows, keep)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_one_of_repeated_rows_stays(frame):
    found = exact_dedup(frame([(1, "a"), (1, "a"), (None, "b"), (None, "b")]), keep="largest").collect()
    assert sorted((r.doc_id or 0, r.kept) for r in found) == [(0, False), (0, True), (1, False), (1, True)]
    kept = without_copies(frame([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b"), (3, None), (4, "")]), keep="largest")
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "b"), (2, "a"), (4, "")]
    assert "bucket" in kept.columns


def test_exact_dedup_runs_no_python_and_takes_empty_tables(frame):
    assert exact_dedup(frame([])).collect() == []
    assert "Python" not in plan_of(exact_dedup(frame(ROWS)))
    with pytest.raises(ValueError):
        exact_dedup(frame(ROWS), keep="first")


def test_tree_gives_the_tightest_bin():
    tree = CapacityTree()
    for number, room in enumerate([5, 9, 7, 7]):
        tree.add(room, number)
    assert tree.take_tightest(6) == (7, 2)
    assert tree.take_tightest(8) == (9, 1)
    assert tree.take_tightest(8) is None
    assert tree.take_roomiest() == (7, 3)


def test_best_fit_decreasing_matches_a_linear_search():
    import random

    sizes = [random.Random(1).randrange(1, 60) for _ in range(1)] + [random.Random(i).randrange(1, 60) for i in range(300)] + [150]
    found = best_fit_decreasing(sizes, 100)
    rooms, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
        if not fits:
            rooms.append(max(100, sizes[i]))
            fits = [(rooms[-1], len(rooms) - 1)]
        b = min(fits)[1]
        rooms[b] -= sizes[i]
        want[i] = b
    assert found == want
    assert best_fit_into([10, 1, 1, 1], 2) == [0, 1, 1, 1]
    assert best_fit_into([], 3) == []


def test_shards_are_even_whole_and_gapless(frame):
    rows = [(i, prose(i, 5 + i % 40)) for i in range(3000)] + [(5000 + i, "hot copy") for i in range(900)] + [(None, None), (None, None)]
    found = shard_documents(frame(rows), 8).collect()
    assert len(found) == len(rows)
    sums, slots, where = Counter(), defaultdict(list), defaultdict(set)
    texts = dict(rows)
    for r in found:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
        text = texts[r.doc_id] or ""
        where[text].add(r.shard)
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) <= 1.01 * min(sums.values())


def test_shards_of_a_capacity_and_edges(frame):
    rows = [(i, "x" * (i % 50)) for i in range(200)] + [(900, "y" * 5000)]
    sums = Counter()
    for r in shard_documents(frame(rows), shards=None, capacity=1000).collect():
        sums[r.shard] += r.size
    assert sum(s > 1000 for s in sums.values()) == 1
    assert shard_documents(frame([]), 8).collect() == []
    with pytest.raises(ValueError):
        shard_documents(frame(rows), 8, capacity=10)


def lines_left(rows, least):
    sites = defaultdict(set)
    for _, text, site in rows:
        for x in (text or "").split("\n"):
            if site is not None:
                sites[x].add(site)
    bad = {x for x, s in sites.items() if len(s) >= least and x.strip(" ")}
    out = []
    for name, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        rest = [x for x in lines if x not in bad]
        out.append((name, len(lines), len(lines) - len(rest), None if text is None else "\n".join(rest)))
    return sorted(out, key=repr)


def test_lines_of_many_sites_go(frame):
    rows = [(i, f"own {i}\ncookie notice\nrare {i % 300}\n\n ", f"s{i % 40}") for i in range(400)]
    rows += [(500 + i, f"near {i % 3}\nx", f"t{i}") for i in range(20)]
    rows += [(600, None, "a"), (601, "", "b"), (602, "cookie notice", None), (None, "cookie notice\nz", "c"), (603, "z" * 200_000, None)]
    rows += [(1, rows[1][1], "s1")]
    for least, few in ((5, FEW), (6, FEW), (7, FEW), (40, FEW), (5, 0), (40, 0)):
        found = line_dedup(frame(rows), least, few=few).collect()
        assert sorted((tuple(r) for r in found), key=repr) == lines_left(rows, least)
    assert line_dedup(frame([])).collect() == []
    assert len(line_dedup(frame([(None, "same\nown", f"s{i}") for i in range(60)] + [(None, None)] * 2)).collect()) == 62


def test_lines_meet_texts_without_an_exchange(frame):
    rows = [(i, f"notice\nown {i}", f"s{i % 9}") for i in range(90)]
    plans = [line_dedup(frame(rows).cache(), few=few)._jdf.queryExecution().executedPlan().toString() for few in (FEW, 0)]
    assert "SortMergeJoin" not in plans[0] and "HashJoin" not in plans[0] and "Join" in plans[1]


def test_spread_counts_exactly_near_the_threshold(frame):
    rows = [(i, "every", f"s{i}") for i in range(100)] + [(200 + i, "most", f"s{i}") for i in range(99)]
    assert [r.sites for r in site_spread(frame(rows), 100).collect()] == [100]
