import pyarrow as pa
import pytest

from groundwork.functions import tools
from groundwork.operators import upsert


def test_table_functions_from_sql(spark):
    tools.register(spark)
    rows = [("a", 2), ("a", 1), ("a", 2), ("b", None), (None, 5), ("b", 3), ("b", None)]
    spark.createDataFrame(rows, "k string, v int").createOrReplaceTempView("pairs")
    got = spark.sql("SELECT * FROM distinct_values_of(TABLE(SELECT k, v FROM pairs) PARTITION BY k ORDER BY v)").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [("a", "1", 1), ("a", "2", 2), ("b", None, 2), ("b", "3", 1), (None, "5", 1)], key=repr
    )
    assert spark.sql("SELECT * FROM distinct_values_of(TABLE(SELECT k, v FROM pairs WHERE false) PARTITION BY k ORDER BY v)").count() == 0


def test_distinct_values_take_whole_batches():
    one = tools.DistinctValues.func()
    batches = [[None] * 5 + [1] * 99_995, [1] * 50_000 + [2] * 50_000, [2], [3]]
    parts = [t for b in batches for t in one.eval(pa.record_batch([pa.array(["a"] * len(b)), pa.array(b, pa.int64())], ["k", "v"]))]
    got = pa.concat_tables([*parts, *one.terminate()])
    assert got.to_pydict() == {"key": ["a"] * 4, "value": [None, "1", "2", "3"], "n_rows": [5, 149_995, 50_001, 1]}
    assert list(tools.DistinctValues.func().terminate()) == []


def test_distinct_values_of_other_types(spark):
    tools.register(spark)
    typed = "float('NaN'), float('NaN'), 0.5f; 1.50, 1.50, 2.00; true, true, false; timestamp_seconds(0), timestamp_seconds(0), null; array(1), array(1), array(2); struct(1 AS a), struct(1 AS a), struct(2 AS a)"
    wanted = [{"nan", "0.5"}, {"1.50", "2.00"}, {"True", "False"}, {"1970-01-01 00:00:00", None}, {"[1]", "[2]"}, {"Row(a=1)", "Row(a=2)"}]
    for values, texts in zip(typed.split(";"), wanted, strict=True):
        got = spark.sql(f"SELECT * FROM distinct_values_of(TABLE(SELECT 'k', explode(array({values})) AS v) PARTITION BY 1 ORDER BY v)").collect()
        assert {r.value for r in got} == texts and sorted(r.n_rows for r in got) == [1, 2]


def test_trace_summary_and_score_from_sql(spark):
    tools.register(spark)
    steps = [("x", 2, "r2"), ("x", 1, None), ("y", 1, "r"), ("y", 2, "")]
    spark.createDataFrame(steps, "e string, step int, result string").createOrReplaceTempView("steps")
    got = spark.sql("SELECT * FROM trace_summary(TABLE(SELECT e, step, result FROM steps) PARTITION BY e ORDER BY step)").collect()
    assert sorted(map(tuple, got), key=repr) == [("x", 2, 1, "r2"), ("y", 2, 1, None)]
    assert spark.sql("SELECT jaro_winkler('abc', 'abc') AS s").first().s == 1.0


def test_configuration_is_replaced_and_read(spark):
    config = spark.createDataFrame([(1, "p", "old", "a"), (4, "m", "x", "b")], "id bigint, key string, value string, agent string")
    given = spark.createDataFrame([("p", "a", "new"), ("z", "c", "1"), ("m", "a", "2")], "key string, agent string, value string")
    got = upsert.config_replace(config, given)
    assert sorted(map(tuple, got.collect())) == [(1, "p", "new", "a"), (4, "m", "x", "b"), (5, "m", "2", "a"), (6, "z", "1", "c")]
    read = upsert.config_values(config, given.select("agent", "key"))
    assert sorted(((r.agent, r.value, r.error) for r in read.collect()), key=repr) == [
        ("a", "old", None),
        ("a", None, "no m configured for a"),
        ("c", None, "no z configured for c"),
    ]
    assert upsert.config_replace(config.limit(0), given).count() == 3
    with pytest.raises(Exception, match="more than once"):
        upsert.config_replace(config, given.unionByName(given)).collect()
