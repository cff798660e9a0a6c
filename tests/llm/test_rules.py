"""Quality rules against plain Python."""

import re
from collections import Counter

import pytest

from groundwork.llm import quality_rules
from groundwork.llm.quality_rules import POLICIES, RULES, Policy, Rule, ablation, apply_policy, failures_by, ledger, measure
from tests.conftest import plan_of
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    " \t\n\x0b\f\r ",
    "one",
    "a b",
    "a b c",
    "a a a a a",
    "a b c a b c",
    "a b c x a b c y b c x",
    "x\nx\n\n \nx \nx\n",
    "#*$%&|<> été \U0001f600中文 a#b",
    "no break space \x1c\x85 kept",
    "\ta  b\r\nc\x0bd\fe",
    prose(1, 400, 9),
    prose(2, 400, 4000),
    "lorem ipsum\n" * 300,
    "q" * 200_000,
    prose(3, 60_000, 60),
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7]), (7, TEXTS[7]), (None, "a b c a b c"), (None, None)]


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines),
        len(lines) - len(set(lines)),
        len(covered),
    )


def found(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in df.collect()), key=repr)


def test_measurements_match_brute_force(frame):
    assert found(measure(frame(ROWS))) == sorted(((i, *by_hand(t)) for i, t in ROWS), key=repr)


@pytest.mark.parametrize("weak", ["CAST(length(words[i]) AS BIGINT)", "7L"])
def test_windows_with_equal_hashes_are_told_apart_by_their_words(frame, monkeypatch, weak):
    monkeypatch.setattr(quality_rules, "WINDOW_HASH", weak)
    rows = [r for r in ROWS if len(r[1] or "") < 10_000]
    assert found(measure(frame(rows))) == sorted(((i, *by_hand(t)) for i, t in rows), key=repr)


def test_no_python_no_shuffle_and_empty_tables(spark, frame):
    plan = plan_of(ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert ledger(frame([])).collect() == []
    assert ablation(ledger(frame([]))).collect() == []
    assert sorted(ledger(frame(ROWS)).columns) == sorted(
        ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failed"]
    )


def test_policies_and_ablation_match_brute_force(frame):
    rows = ROWS + [(100 + i, prose(i, 80, 500) + (" #" * (i % 3) * 6)) for i in range(30)]
    book = ledger(frame(rows))
    bits = [r.failed for r in book.collect()]
    masks = {p.version: p.mask() for p in POLICIES}
    for policy in POLICIES:
        kept = apply_policy(book, policy).where("kept").count()
        assert kept == sum(not b & masks[policy.version] for b in bits)
    got = {(r.version, r.rule): tuple(r)[2:] for r in ablation(book).collect()}
    want = {}
    for p in POLICIES:
        m = masks[p.version]
        for rule in RULES:
            if rule.name in p.rules:
                bit = 1 << rule.bit
                want[p.version, rule.name] = (
                    len(bits),
                    sum(bool(b & bit) for b in bits),
                    sum(b & m == bit for b in bits),
                    sum(not b & m for b in bits),
                    sum(not b & m & ~bit for b in bits),
                )
    assert got == want
    assert all(r[4] == r[3] + r[2] for r in got.values())
    whole = failures_by(book.selectExpr("failed", "1 AS one"), "one").first()
    any_bits, all_bits = 0, -1
    for b in bits:
        any_bits, all_bits = any_bits | b, all_bits & b
    assert (whole.n_docs, whole.any_failed, whole.all_failed) == (len(bits), any_bits, all_bits)


def test_bad_rules_and_policies_are_refused(frame):
    with pytest.raises(ValueError):
        ledger(frame([]), rules=(Rule("a", 0, "true"), Rule("b", 0, "true")))
    with pytest.raises(ValueError):
        Policy("x", ("nothing",)).mask()
