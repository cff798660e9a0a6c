import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundwork.errors import ConfigNotFound
from groundwork.operators import quality, upsert

TARGET = "k int, name string, qty int, flag string"
SOURCE = "k int, name string, qty int"


def both_ways(spark, run):
    """The result with a broadcastable source and with one that is not."""
    small = sorted(map(tuple, run().collect()), key=repr)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = sorted(map(tuple, run().collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert small == large
    return small


def test_merge_updates_inserts_and_keeps(spark):
    target = spark.createDataFrame([(1, "a", 10, "Y"), (2, "b", 20, "N"), (None, "n", 0, "Y")], TARGET)
    source = spark.createDataFrame([(2, "B", None), (3, "c", 30), (None, "m", 5)], SOURCE)
    defaults = {"flag": F.lit("Y"), "qty": F.lit(7)}
    merged = both_ways(spark, lambda: upsert.merge_into(target, source, ["k"], ["name", "qty"], defaults))
    assert merged == sorted(
        # A matched NULL overwrites, an inserted NULL takes the default, NULL keys never match.
        [(1, "a", 10, "Y"), (2, "B", None, "N"), (3, "c", 30, "Y"), (None, "n", 0, "Y"), (None, "m", 5, "Y")],
        key=repr,
    )


def test_merge_leaves_unlisted_columns(spark):
    target = spark.createDataFrame([(1, "a", 10, "Y")], TARGET)
    source = spark.createDataFrame([(1, "z", 99)], SOURCE)
    assert both_ways(spark, lambda: upsert.merge_into(target, source, ["k"], ["qty"])) == [(1, "a", 99, "Y")]


def test_composite_keys_replace_configuration(spark):
    schema = "key string, agent string, value string"
    target = spark.createDataFrame([("profile", "a", "old"), ("profile", "b", "keep")], schema)
    source = spark.createDataFrame([("profile", "a", "new"), ("model", "a", "m")], schema)
    merged = upsert.merge_into(target, source, ["key", "agent"], ["value"])
    assert upsert.config_value(merged, "a", "profile") == "new"
    assert upsert.config_value(merged, "b", "profile") == "keep"
    assert upsert.config_value(merged, "a", "model") == "m"
    with pytest.raises(ConfigNotFound):
        upsert.config_value(merged, "b", "model")


rows = st.dictionaries(st.integers(0, 12), st.tuples(st.sampled_from("abc"), st.integers(0, 5)), max_size=10)


@settings(max_examples=8, deadline=None)
@given(rows, rows)
def test_merge_is_idempotent_and_exact(spark, stored, changes):
    target = spark.createDataFrame([(k, n, q, "Y") for k, (n, q) in stored.items()], TARGET)
    source = spark.createDataFrame([(k, n, q) for k, (n, q) in changes.items()], SOURCE)

    def merge(t):
        return upsert.merge_into(t, source, ["k"], ["name", "qty"], {"flag": F.lit("N")})

    expected = {k: (n, q, "Y") for k, (n, q) in stored.items()}
    for k, (n, q) in changes.items():
        expected[k] = (n, q, "Y" if k in stored else "N")
    once = both_ways(spark, lambda: merge(target))
    assert {r[0]: r[1:] for r in once} == expected
    assert sorted(map(tuple, merge(merge(target)).collect()), key=repr) == once


def test_small_source_leaves_the_target_unshuffled(spark, plan):
    target = spark.range(1000).selectExpr("id AS k", "CAST(id AS STRING) AS name")
    source = spark.sql("SELECT * FROM VALUES (3L, 'x'), (5000L, 'y') AS t(k, name)")
    text = plan(upsert.merge_into(target, source, ["k"], ["name"]))
    assert "FullOuter" not in text and "SortMergeJoin" not in text


def test_latest_per_key(spark, rows):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, None, 2), (2, "z", 1)], "k int, v string, at int")
    assert rows(upsert.latest_per_key(df, ["k"], ["at"])) == [(1, "b", 3), (2, "z", 1)]


CATALOG = "agent_id string, agent_name string, deployment_target string, status string, created_at timestamp_ntz, updated_at timestamp_ntz"


def _catalog(spark):
    df = spark.createDataFrame(
        [("a", "A", "DB_NATIVE", "DECOMMISSIONED"), ("b", "B", "HYBRID", "ACTIVE")],
        "agent_id string, agent_name string, deployment_target string, status string",
    )
    old = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return df.withColumn("created_at", old).withColumn("updated_at", old)


def test_provisioning_reactivates_and_keeps_creation(spark):
    provisioned = spark.createDataFrame([("a", "A2", "HYBRID"), ("c", "C", None)], "agent_id string, agent_name string, deployment_target string")
    now = F.lit("2025-05-05 00:00:00").cast("timestamp_ntz")
    after = {r.agent_id: r for r in upsert.catalog_upsert(_catalog(spark), provisioned, now).collect()}
    assert set(after) == {"a", "b", "c"}
    assert (after["a"].agent_name, after["a"].status, after["a"].created_at.year, after["a"].updated_at.year) == ("A2", "ACTIVE", 2024, 2025)
    assert (after["b"].status, after["b"].updated_at.year) == ("ACTIVE", 2024)
    assert (after["c"].deployment_target, after["c"].created_at.year) == ("HYBRID", 2025)


def test_soft_delete_by_list_and_by_frame(spark, rows):
    now = F.lit("2025-05-05 00:00:00").cast("timestamp_ntz")
    ids = spark.createDataFrame([("b",), ("b",), ("zz",)], "x string")
    by_list = upsert.soft_delete(_catalog(spark), "agent_id", ["b", "zz"], now)
    by_frame = upsert.soft_delete(_catalog(spark), "agent_id", ids, now)
    assert rows(by_list) == rows(by_frame)
    assert rows(by_frame, "agent_id", "status") == [("a", "DECOMMISSIONED"), ("b", "DECOMMISSIONED")]
    assert by_frame.where("agent_id = 'a'").first().updated_at.year == 2024


def test_cascade_delete(spark, rows):
    parent = spark.createDataFrame([(1,), (2,)], "p int")
    child = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "c int, ref int")
    left, kept = upsert.cascade_delete(parent, child, "p", "ref", spark.createDataFrame([(1,)], "x int"))
    assert rows(left) == [(2,)]
    assert rows(kept) == [(11, 2), (12, None)]


def test_patch_ignores_blanks(spark, rows):
    df = spark.createDataFrame([(1, "n", "d", 5), (2, "m", "e", 6)], "id int, name string, domain string, n int")
    changes = spark.createDataFrame([(1, "", "", None), (3, "x", "x", 1)], "id int, name string, domain string, n int")
    assert rows(upsert.patch(df, changes, "id", ["domain"])) == [(1, "n", "", 5), (2, "m", "e", 6)]


def test_lookup_prefers_the_primary(spark, rows):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    primary = spark.createDataFrame([(1, "p", None)], "id int, name string, x string")
    fallback = spark.createDataFrame([(1, "f", "x"), (2, "f", "x")], "id int, name string, x string")
    found = upsert.lookup(ids, "id", primary, fallback, ["name", "x"])
    # The primary row is taken whole, its NULL included.
    assert rows(found) == [(1, "p", None, "primary"), (2, "f", "x", "fallback"), (3, None, None, None)]


def test_uniqueness(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c")], "k int, v string")
    assert rows(quality.unique_violations(df, ["k", "v"])) == [(1, "a", 2), (None, "c", 2)]


def test_rules_pass_on_unknown(spark):
    df = spark.createDataFrame([("Y", 1.0), ("X", 99999.0), (None, None)], "flag string, v double")
    rules = {
        "flag": quality.in_set("flag", ["Y", "N"]),
        "present": quality.not_null("flag"),
        "narrow": quality.fits_precision("v", 6, 2),
        "range": quality.between("v", 0, 10),
    }
    report = {r.rule: (r.n_rows, r.n_violations) for r in quality.check_report(df, rules).collect()}
    assert report == {"flag": (3, 1), "present": (3, 1), "narrow": (3, 1), "range": (3, 1)}
    empty = quality.check_report(df.limit(0), rules).collect()
    assert {(r.n_rows, r.n_violations) for r in empty} == {(0, 0)}


def test_precision_counts_rounding(spark):
    df = spark.createDataFrame([(999.994,), (999.996,), (-999.99,)], "v double")
    report = quality.check_report(df, {"fits": quality.fits_precision("v", 5, 2)}).first()
    assert report.n_violations == 1


def test_orphans(spark, rows):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "ref int")
    parent = spark.createDataFrame([(2,), (3,)], "id int")
    assert rows(quality.fk_orphans(child, "ref", parent, "id")) == [(1, 2)]


def test_contract(spark):
    good = ("e", "a", "n", "d", "HYBRID", "x", 0.9, 5.0)
    bad = ("e", "a", None, "d", "CLOUD", "x", 1.2, -1.0)
    df = spark.createDataFrame([good, bad], "executionId string, agentId string, agentName string, domain string, deploymentTarget string, data string, c double, l double")
    df = df.withColumn("metadata", F.struct(F.col("c").alias("confidence"), F.col("l").alias("latencyMs")))
    broken = {r.rule for r in quality.contract_violations(df).collect() if r.n_violations}
    assert broken == {"agentName present", "deploymentTarget known", "confidence in [0, 1]", "latencyMs not negative"}


def test_a_source_with_a_key_twice_fails(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    twice = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    for change in (lambda: upsert.merge_into(target, twice, ["k"], ["v"]), lambda: upsert.patch(target, twice, "k")):
        with pytest.raises(Exception, match="more than once"):
            change().collect()
    unknown = spark.createDataFrame([(None, "b"), (None, "c")], "k int, v string")
    assert upsert.merge_into(target, unknown, ["k"], ["v"]).count() == 3


def test_a_hot_parent_key_counts_once(spark, plan):
    child = spark.createDataFrame([(1,), (3,)], "ref int")
    parent = spark.createDataFrame([(1,)] * 500 + [(2,)], "id int")
    orphans = quality.fk_orphans(child, "ref", parent, "id")
    assert [tuple(r) for r in orphans.collect()] == [(3, 1)]
    assert plan(orphans).count("HashAggregate") >= 4
