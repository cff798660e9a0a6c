"""Conversation repair against exhaustive search."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash

from groundwork.llm.alignment import DONE, START, SYSTEM, USER, Part, joined, whole
from groundwork.llm.conversations import damaged, op11, repair_conversations, repaired_turns
from groundwork.llm.registry import table

DDL = "conv_id long, turn long, role string, text string, part int, pos long, audit string, row string, times int"
NEXT = {START: USER, SYSTEM: USER, USER: DONE, DONE: USER}


def cheapest(initials, must_go, cut):
    """(cost, audit) by trying every edit."""
    n = len(initials)

    @functools.lru_cache(None)
    def best(i, state, inserts):
        options = [(0, "")] if i == n and state in (START, DONE) else []

        def add(cost, edit, rest):
            if rest is not None:
                options.append((cost + rest[0], edit + rest[1]))

        after = NEXT[state]
        letter = "u" if after == USER else "a"
        if inserts < n + 2:
            add(3, "I", best(i, after, inserts + 1))
        if i < n:
            add(4, "D", best(i + 1, state, inserts))
            if not must_go[i]:
                more = 3 * cut[i]
                add(more + 3 * (initials[i] != letter), "K" if initials[i] == letter else "R", best(i + 1, after, inserts))
                if state == START and initials[i] == "s":
                    add(more, "K", best(i + 1, SYSTEM, inserts))
        return min(options) if options else None

    return best(0, START, 0)


def by_hand(rows):
    """The contract's row of one conversation from its (turn, role, text) rows in order."""
    seen, blank, again, cut = set(), [], [], []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        blank.append(not words)
        again.append(bool(words) and (role, text) in seen)
        seen.add((role, text))
        cut.append(bool(words) and not again[-1] and words[-1] not in ".!?")
    initials = [r[1][:1] for r in rows]
    cost, audit = cheapest(tuple(initials), tuple(a or b for a, b in zip(blank, again, strict=True)), tuple(cut))
    out, i = [], 0
    for edit in audit:
        expected = "assistant" if out and out[-1].startswith("u") else "user"
        if edit == "I":
            out.append(expected + ":")
            continue
        _, role, text = rows[i]
        i += 1
        if edit != "D":
            out.append(f"{role if edit == 'K' else expected}:{text}")
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, sum(blank), sum(again), sum(cut), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def text_order(text):
    number = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return number - (number >> 63 << 64)


def grouped(rows):
    found = defaultdict(list)
    for name, turn, role, text in rows:
        found[name].append((turn, " " if role is None else role, " " if text is None else text))
    for turns in found.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], text_order(r[2])))
    return found


def wanted(rows):
    return sorted(((n, *by_hand(turns)[0]) for n, turns in grouped(rows).items()), key=repr)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "a", "r", 9) for r in rows], DDL).repartition(parts)


def talk(seed, name, n, faults=0.3):
    pick = random.Random(seed)
    rows = []
    for turn in range(n):
        role, text = ("user", "assistant")[turn % 2], f"text {pick.randrange(1000)}."
        if pick.random() < faults:
            role, text = pick.choice([(role, ""), (role, "\t "), (role, "cut"), ("system", text), ("tool", text), ("user", text), (None, text), (role, None), ("", text)])
        rows.append((name, turn + pick.randrange(2) * 100, role, text))
    return rows


def test_alignment_matches_exhaustive_search_whole_and_in_parts():
    pick = random.Random(1)
    for _ in range(1500):
        n = pick.randrange(9)
        part = Part([pick.choice(["s", "s", "u", "u", "a", "a", "x", ""]) for _ in range(n)], [pick.random() < 0.2 for _ in range(n)], [pick.random() < 0.2 for _ in range(n)])
        best = cheapest(tuple(part.initials), tuple(part.must_go), tuple(part.cut))
        assert whole(part.solve((START,), (START, DONE))) == best
        cuts = sorted(pick.randrange(n + 1) for _ in range(pick.randrange(3)))
        pieces = [Part(part.initials[a:b], part.must_go[a:b], part.cut[a:b]) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        assert whole(joined([p.solve() for p in pieces])) == best


@pytest.mark.parametrize("limits", [{}, {"most_turns": 3, "block": 4}, {"most_chars": 10, "block": 1}])
def test_conversations_match_exhaustive_search(spark, limits):
    rows = [r for c in range(25) for r in talk(c, c, c % 9)] + talk(99, None, 9) + talk(7, 500, 60, 0.4)
    rows += [(600, None, "user", "a."), (600, None, "user", "a."), (600, 1, "assistant", "b."), (600, 1, "assistant", "b."), (601, None, None, None)]
    rows += [(602, 0, "user", "x" * 100_000 + "."), (602, 1, "assistant", "y" * 100_000 + "!")]
    df = frame(spark, rows)
    report = repair_conversations(df, **limits)
    assert sorted((tuple(r) for r in report.collect()), key=repr) == wanted(rows)
    found = defaultdict(list)
    for r in repaired_turns(df, report).orderBy("conv_id", "place").collect():
        found[r.conv_id].append(f"{r.role}:{r.text}")
    assert found == {n: out for n, turns in grouped(rows).items() if (out := by_hand(turns)[1])}


def test_one_conversation_over_all_partitions(spark):
    rows = talk(3, 1, 400, 0.2) + [(1, 50, "user", "same.")] * 30 + talk(4, 2, 5)
    many = repair_conversations(frame(spark, rows, 4), most_turns=20, block=16).collect()
    one = repair_conversations(frame(spark, rows, 1), most_turns=10_000).collect()
    assert sorted(map(tuple, many)) == sorted(map(tuple, one)) == wanted(rows)


def test_empty_tables_and_damage_rule(spark):
    assert repair_conversations(frame(spark, [])).collect() == []
    rows = [(c, t, "assistant", "one. two") for c in range(40) for t in (None, *range(9))] + [(None, 3, None, None)]
    got = sorted((tuple(r) for r in damaged(frame(spark, rows)).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want.append((c, t, "user" if kind == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text), {0: 0, 3: 2}.get(kind, 1)))
    assert got == sorted(want, key=repr)


def test_query_matches_exhaustive_search(spark):
    directory = "/root/testdata/sf0.001"
    rows, names = [], set()
    for r in damaged(table(spark, directory, "conversations")).collect():
        names.add(r.conv_id)
        rows += [(r.conv_id, r.turn, r.role, r.text)] * r.times
    want = {n: by_hand(turns)[0] for n, turns in grouped(rows).items()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = [tuple(r) for r in op11(spark, directory).collect()]
    assert sorted(got) == sorted((n, *want.get(n, empty)) for n in names)
