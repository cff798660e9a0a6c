"""One key holds a third of the rows: results stay whole and adaptive execution splits the key."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from groundwork.operators import audit, graph, joins, ledger, quality, upsert, vectors
from tests.conftest import plan_of

ROWS = 60_000

TIGHT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "48KB",
    "spark.sql.shuffle.partitions": "24",
}


@contextmanager
def tight(spark):
    """Small thresholds, so that test-sized skew looks like cluster-sized skew."""
    before = {k: spark.conf.get(k, None) for k in TIGHT}
    for k, v in TIGHT.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def trail(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("skew") / "trail")
    actor = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
    spark.range(0, ROWS, 1, 16).select(
        F.col("id").alias("event_id"),
        actor.alias("actor"),
        F.when(F.col("id") % 3 == 0, "grant").otherwise(F.concat(F.lit("a"), F.col("id") % 50)).alias("action"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 100000)").alias("ts"),
        (F.col("id") % 11).alias("origin"),
        F.rand(3).alias("value"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan_of(df)


def test_anti_join_splits_the_hot_actor(spark, trail):
    with tight(spark):
        found = audit.unauthorised_actions(trail, ["grant"] + [f"a{i}" for i in range(50)], spark.range(8, 4000))
        plan = final_plan(found)
        assert "skew=true" in plan
        # Actors below 8 and from 4000 on are not cleared.
        expected = trail.where((F.col("actor") < 8) | (F.col("actor") >= 4000)).count()
        assert found.count() == expected > ROWS / 3


def test_outliers_leave_heavy_groups_where_they_are(spark, trail, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_GROUPS", 10)
    found = ledger.zscore_outliers(trail, "action", "value", z=1.5)
    # Only "grant" is heavy: its summary is broadcast, the 50 others join by shuffle.
    moments = trail.groupBy("action").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("d"))
    expected = trail.join(moments, "action").where(F.abs((F.col("value") - F.col("m")) / F.col("d")) > 1.5)
    with tight(spark):
        plan = final_plan(found)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
        assert found.count() == expected.count() > 0
        assert found.where("action = 'grant'").count() == expected.where("action = 'grant'").count() > 0
    assert found.select("event_id").exceptAll(expected.select("event_id")).isEmpty()


def test_patch_splits_the_hot_key(spark, trail):
    with tight(spark):
        changes = spark.range(0, 5000).select(F.col("id").alias("actor"), F.lit("x").alias("payload"))
        patched = upsert.patch(trail, changes, "actor")
        assert "skew=true" in final_plan(patched)
        assert patched.where("payload = 'x'").count() == ROWS


def test_orphans_travel_as_one_row_per_key(spark, trail, rows):
    with tight(spark):
        orphans = quality.fk_orphans(trail, "actor", spark.range(8, 100_000), "id")
        plan = final_plan(orphans)
        # The child is counted in each task before anything is shuffled.
        assert "partial_count" in plan and "skew=true" not in plan
        assert max(r.n_rows for r in orphans.collect()) > ROWS / 3


def test_hub_vertex(spark):
    with tight(spark):
        hub = spark.range(20_000).select(
            F.lit("hub").alias("src"), F.concat(F.lit("v"), F.col("id")).alias("dst"), F.lit(1.0).alias("transit_days"), F.lit(1.0).alias("cost"), F.lit(0.1).alias("risk")
        )
        chain = spark.range(40_000).select(
            F.concat(F.lit("v"), F.col("id")).alias("src"), F.lit("hub").alias("dst"), F.lit(1.0).alias("transit_days"), F.lit(1.0).alias("cost"), F.lit(0.1).alias("risk")
        )
        reached = graph.khop(hub.unionByName(chain), spark.createDataFrame([("v1",), ("v2",)], "start string"), 3)
        assert reached.groupBy("hops").count().orderBy("hops").collect() == [(0, 2), (1, 2), (2, 2 * 19_999)]


def test_identical_copies_in_one_cell(spark, tmp_path, monkeypatch):
    """A third of the corpus is one vector; the id decides among its copies."""
    copies = F.array(*[F.lit(float(x)).cast("float") for x in (1, 0, 0)])
    noise = F.array(*[F.rand(s).cast("float") - 0.5 for s in (1, 2, 3)])
    path = str(tmp_path / "v")
    spark.range(0, 6000, 1, 6).select("id", F.when(F.col("id") % 3 == 0, copies).otherwise(noise).alias("embedding")).write.parquet(path)
    corpus = spark.read.parquet(path)
    asked = corpus.where("id < 60").select(F.col("id").alias("query_id"), "embedding")
    index = vectors.build_ivf(corpus, str(tmp_path / "ivf"), cells=8)

    def found(df):
        return sorted((r.query_id, r["rank"], r.id) for r in df.collect())

    expected = found(vectors.vector_topk_batch(corpus, asked, 5))
    assert expected[:5] == [(0, 1, 0), (0, 2, 3), (0, 3, 6), (0, 4, 9), (0, 5, 12)]
    assert found(vectors.ivf_topk(spark, index, asked, 5, nprobe=8)) == expected
    monkeypatch.setattr(vectors, "MAX_BROADCAST_QUERIES", 7)
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", 500)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 20)
    assert found(vectors.vector_topk_batch(corpus, asked, 5)) == expected
    assert found(vectors.ivf_topk(spark, index, asked, 5, nprobe=8)) == expected


def test_ranking_is_cut_before_the_shuffle(spark, tables):
    corpus = tables["embeddings"].selectExpr("vec_id AS id", "embedding")
    asked = corpus.limit(3).withColumnRenamed("id", "query_id")
    plan = plan_of(vectors.vector_topk_batch(corpus, asked, 5))
    shuffle = plan.index("Exchange hashpartitioning(query_id")
    assert "WindowGroupLimit" in plan[:shuffle] and "WindowGroupLimit" in plan[shuffle:]
