import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.errors import ColumnNotFound, UnsupportedColumnType
from groundwork.functions import similarity
from groundwork.functions.similarity import jaro_winkler_scores
from groundwork.operators import fuzzy, profiling

WORDS = ["click", "view", "purchase", "signup", "error"]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(w, i) for i, w in enumerate(WORDS * 3)] + [(None, 99), ("", 100)], "word string, n int")


def values(df):
    return sorted(r.value for r in df.collect())


def test_all_values_without_nulls(names):
    assert values(profiling.distinct_values(names, "word")) == sorted(WORDS + [""])
    assert values(profiling.distinct_values(names, "WORD", "   ", "exact")) == sorted(WORDS + [""])


def test_exact_is_not_trimmed(names):
    assert values(profiling.distinct_values(names, "word", "click", " Exact ")) == ["click"]
    # Nothing equals " click", so everything comes back.
    assert len(values(profiling.distinct_values(names, "word", " click", "exact"))) == 6


def test_exact_on_numbers(names):
    assert values(profiling.distinct_values(names, "n", "7", "exact")) == [7]
    assert len(values(profiling.distinct_values(names, "n", "seven", "exact"))) == 17


def test_regex_is_partial_and_ignores_case(names):
    assert values(profiling.distinct_values(names, "word", "^V|RR", "regex")) == ["error", "view"]
    with pytest.raises(ValueError, match="invalid pattern"):
        profiling.distinct_values(names, "word", "(", "regex")


@pytest.mark.parametrize("kind", [None, "", "sounds like", "fuzzy", " FUZZY "])
def test_fuzzy_is_the_default(names, kind):
    assert values(profiling.distinct_values(names, "word", "clck", kind)) == ["click"]


def test_fuzzy_is_scored_once_per_value(names, plan):
    text = plan(profiling.judged_values(names, "word", "clck", None))
    first = text.index("ArrowEvalPython")
    assert "HashAggregate" in text[first : text.index("Scan", first)]


def test_missing_column(names):
    with pytest.raises(ColumnNotFound):
        profiling.distinct_values(names, "nope")
    with pytest.raises(ColumnNotFound):
        profiling.range_values(names, "nope")


def test_truncation_keeps_whole_values(spark):
    df = spark.createDataFrame([("b" * 10,), ("a",), ('q"',), ("c",)], "value string")
    # ["a" is 4 characters, ,"bbbbbbbbbb" 13 more, ,"c" 4 more, ,"q\"" 6 more, ] is counted once.
    kept = profiling.truncate_values(df, 22).orderBy("value").collect()
    assert [(r.value, r.truncated) for r in kept] == [("a", True), ("b" * 10, True), ("c", True)]
    assert not any(r.truncated for r in profiling.truncate_values(df, 28).collect())
    assert profiling.truncate_values(df, 28).count() == 4
    assert profiling.truncate_values(df.limit(0)).count() == 0
    assert [tuple(r) for r in profiling.truncate_values(df, 3).collect()] == [(None, True)]


def test_truncated_list_is_within_the_budget(tables):
    import json

    kept = profiling.truncate_values(profiling.distinct_values(tables["customer"], "c_name"), 1000)
    listed = json.dumps(sorted(r.value for r in kept.collect()), separators=(",", ":"))
    assert 975 < len(listed) <= 1000


def test_ranges(spark, names):
    assert tuple(profiling.range_values(names, "n").first()) == ("n", 0, 100)
    empty = profiling.range_values(names.limit(0), "n").first()
    assert (empty.min_value, empty.max_value) == (None, None)
    with pytest.raises(UnsupportedColumnType):
        profiling.range_values(names, "word")


def test_diagnosis_of_an_empty_result(names, rows):
    report = profiling.diagnose_empty(names, [("word", "clik"), ("n", 5000)], k=2).collect()
    by_finding = {(r.column_name, r.finding, r["rank"]): r.value for r in report}
    assert by_finding[("n", "min", 1)] == "0" and by_finding[("n", "max", 1)] == "100"
    assert by_finding[("word", "nearest", 1)] == "click"
    assert by_finding[("n", "outside", 1)] == "5000"
    assert len(report) == 5
    inside = profiling.diagnose_empty(names, [("n", 50), ("word", "x"), ("word", "y")], k=1).collect()
    assert sorted(r.finding for r in inside) == ["max", "min", "nearest", "nearest"]


def test_patterns_read_the_table_once(spark, tmp_path, plan):
    spark.createDataFrame([("alpha",), ("beta",)], "word string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for kind in ("exact", "regex", "fuzzy"):
        found = profiling.distinct_values(df, "word", "alpha", kind)
        assert "FileScan" not in plan(found)  # read into the checkpoint already, once
        assert {r.value for r in found.collect()} == {"alpha"}


words = st.text(alphabet="abcdeé ", max_size=80)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcd", max_size=90), st.text(alphabet="abcd", max_size=90)), min_size=1, max_size=20))
def test_scores_equal_an_independent_implementation(pairs):
    con = duckdb.connect()
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    expected = [con.execute("SELECT jaro_winkler_similarity(?, ?)", list(p)).fetchone()[0] for p in pairs]
    assert jaro_winkler_scores(left, right).tolist() == pytest.approx(expected, abs=1e-12)


@settings(max_examples=100, deadline=None)
@given(words, words)
def test_score_range_and_identity(a, b):
    score, same = jaro_winkler_scores([a, a], [b, a])
    assert 0 <= score <= 1
    assert same == (1 if a else 0)
    if a and b and not set(a) & set(b):
        assert score == 0


def test_long_and_short_pairs_share_one_definition():
    a, b = "abcab" * 11, "bacab" * 11
    expected = similarity._jaro_matrix([a], [b])[0]
    assert similarity._jaro_one(a, b) == pytest.approx(expected)


def test_null_inputs_give_null(spark):
    spark.createDataFrame([("a", None), (None, "b"), ("ab", "ab")], "x string, y string").createOrReplaceTempView("jw")
    similarity.register(spark)
    assert [r[0] for r in spark.sql("SELECT jaro_winkler(x, y) FROM jw").collect()] == [None, None, 1.0]


def _brute_pairs(names, min_score, block=0):
    distinct = sorted({n for n in names if len(n) >= max(block, 1)})
    pairs = [(a, b) for a in distinct for b in distinct if a < b and a[:block] == b[:block]]
    if not pairs:
        return set()
    scores = jaro_winkler_scores([p[0] for p in pairs], [p[1] for p in pairs])
    return {p for p, s in zip(pairs, scores) if s >= min_score}


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.builds(lambda p, s: p + s, st.sampled_from(["abc", "abd", "xyz", "ab"]), st.text("abcdexyz ", max_size=12)), max_size=60),
    st.sampled_from([0.8, 0.87, 0.93]),
)
def test_fuzzy_pairs_miss_nothing(spark, names, min_score):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    found = fuzzy.fuzzy_pairs(df, "name", min_score=min_score).collect()
    assert {(r.name_a, r.name_b) for r in found} == _brute_pairs(names, min_score)
    assert len(found) == len({(r.name_a, r.name_b) for r in found})


def test_fuzzy_pairs_in_one_hot_block_form_few_candidates(spark, plan):
    import random

    random.seed(5)
    names = ["The" + "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(6, 14))) for _ in range(1500)]
    names += [n[:-1] + "!" for n in names[:50]]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    found = {(r.name_a, r.name_b) for r in fuzzy.fuzzy_pairs(df, "name", min_score=0.93).collect()}
    assert found == _brute_pairs(names, 0.93)


def test_fuzzy_pairs_need_no_common_prefix(spark):
    df = spark.createDataFrame([("The Acme Stores",), ("Teh Acme Stores",), ("ab",), ("a",), ("",)], "name string")
    assert {(r.name_a, r.name_b) for r in fuzzy.fuzzy_pairs(df, "name").collect()} == {("Teh Acme Stores", "The Acme Stores")}
    assert fuzzy.fuzzy_pairs(df, "name", block=3).count() == 0


def test_fuzzy_pairs_count_rows_of_each_name(spark):
    df = spark.createDataFrame([("hot plate",)] * 3 + [("hot plates",)] * 2, "name string")
    row = fuzzy.fuzzy_pairs(df, "name").first()
    assert (row.name_a, row.name_b, row.rows_a, row.rows_b) == ("hot plate", "hot plates", 3, 2)


def test_fuzzy_pairs_refuse_an_unbounded_threshold(names):
    with pytest.raises(ValueError):
        fuzzy.fuzzy_pairs(names, "word", min_score=0.5)
