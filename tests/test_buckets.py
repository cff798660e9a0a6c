import pytest
from pyspark.sql import functions as F

from groundwork.errors import TableNotFound
from groundwork.operators import upsert
from groundwork.sources import buckets
from groundwork.sources.buckets import BucketedTable, bucket_of
from groundwork.sources.versions import complete_versions
from groundwork.streaming import jobs

ROWS = "k bigint, a string, b int"


@pytest.fixture
def table(spark, tmp_path):
    start = spark.range(1000).selectExpr("id AS k", "concat('a', id) AS a", "CAST(id AS int) AS b")
    return buckets.create(start, str(tmp_path / "t"), ["k"], 64)


def loads(table):
    return {r["bucket"]: r["load"] for r in table._list()}


def test_ten_keys_rewrite_ten_buckets_at_most(spark, table):
    before = loads(table)
    source = spark.createDataFrame([(i * 37, f"new{i}", None) for i in range(9)] + [(5000, "inserted", 1)], ROWS)
    want = upsert.merge_into(table.read(), source, ["k"], ["a"], {"b": F.lit(-1)}).collect()
    touched = table.merge(source, ["a"], {"b": F.lit(-1)})
    assert sorted(table.read().collect()) == sorted(want)
    after = loads(table)
    changed = {b for b in after if after[b] != before[b]}
    assert len(changed) <= 10 and changed == set(touched)
    written = {f.split("bucket=")[1].split("/")[0] for f in table.read(buckets=touched).inputFiles()}
    assert written == {str(b) for b in touched}


def test_versions_stay_readable_and_replays_publish_the_same(spark, table):
    first = sorted(table.read().collect())
    source = spark.createDataFrame([(1, "x", 1)], ROWS)
    for _ in range(2):  # the same version again, as after a failure before the commit
        table.merge(source, ["a"], version=1)
    assert complete_versions(spark, table.root) == [0, 1]
    assert sorted(table.read(below=1).collect()) == first
    assert table.read().where("k = 1").first().a == "x" and table.read().count() == 1000
    again = sorted(table.read().collect())
    assert table.vacuum(keep=1) == 1
    assert sorted(table.read().collect()) == again
    with pytest.raises(TableNotFound):
        BucketedTable(spark, table.root + "x").read()


def test_empty_sources_empty_buckets_and_null_keys(spark, tmp_path):
    table = buckets.create(spark.createDataFrame([], ROWS), str(tmp_path / "e"), ["k"], 8)
    assert table.read().collect() == [] and table.read().columns == ["k", "a", "b"]
    assert table.merge(spark.createDataFrame([], ROWS), ["a"]) == []
    table.merge(spark.createDataFrame([(None, "n", 1), (None, "n", 1), (3, "t", 2)], ROWS), ["a"])
    assert table.read().count() == 3
    table.merge(spark.createDataFrame([(None, "n", 1)], ROWS), ["a"])
    assert table.read().count() == 4
    with pytest.raises(Exception, match="more than once"):
        table.merge(spark.createDataFrame([(3, "a", 1), (3, "b", 1)], ROWS), ["a"])
    with pytest.raises(ValueError):
        buckets.create(table.read(), str(tmp_path / "f"), ["k"], 0)


def test_keys_of_any_width_share_a_bucket(spark):
    row = spark.createDataFrame([(7, 7)], "a int, b bigint").select(bucket_of(["a"], 64).alias("x"), bucket_of(["b"], 64).alias("y")).first()
    assert row.x == row.y


def test_streamed_changes_touch_their_buckets_in_any_order(spark, tmp_path):
    schema = "agent_id string, agent_name string, deployment_target string, sent_at int"
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    start = spark.range(200).select(F.concat(F.lit("k"), "id").alias("agent_id"), F.lit("old").alias("agent_name"), F.lit("HYBRID").alias("deployment_target"), F.lit("DECOMMISSIONED").alias("status"), at.alias("created_at"), at.alias("updated_at"))
    table = buckets.create(start, str(tmp_path / "table"), ["agent_id"], 32)
    src, as_of = str(tmp_path / "in"), lambda: F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    for sent, name in ((9, "newest"), (1, "stale"), (9, "same time"), (5, "stale too")):
        spark.createDataFrame([("k1", name, None, sent), (f"n{sent}", name, None, sent)], schema).coalesce(1).write.mode("append").parquet(src)
        before = loads(table)
        feed = jobs.read_feed(spark, src, schema, per_batch=1)
        jobs.stream_upsert(feed, table.root, str(tmp_path / "state"), ["sent_at"], as_of).awaitTermination()
        after = loads(table)
        assert sum(after[b] != before[b] for b in after) <= 2
    found = {r.agent_id: (r.agent_name, r.status) for r in table.read().where("agent_name <> 'old'").collect()}
    assert found == {"k1": ("same time", "ACTIVE"), "n9": ("same time", "ACTIVE"), "n1": ("stale", "ACTIVE"), "n5": ("stale too", "ACTIVE")}
    assert table.read().count() == 203


def test_counters_are_compacted_and_replay_safe(spark, tmp_path):
    feed_schema = "id bigint, ts timestamp_ntz, agent string, line string"
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i in range(11):
        day = spark.createDataFrame([(i, "ab"[i % 2])], "id bigint, agent string").select(
            "id", F.lit(f"2024-01-{1 + i % 3:02d} 01:00:00").cast("timestamp_ntz").alias("ts"), "agent", F.lit("x").alias("line")
        )
        day.coalesce(1).write.mode("append").parquet(src)

    def run():
        feed = jobs.read_feed(spark, src, feed_schema, per_batch=1)
        jobs.stream_agent_counts(feed, "ts", "agent", out, state, compact_every=3).awaitTermination()
        return sorted((r.window_start.day, r.agent_id, r.invocations) for r in jobs.read_agent_counts(spark, out).collect())

    got = run()
    assert sum(r[2] for r in got) == 11 and len(got) == 6
    files = jobs.read_agent_counts(spark, out).inputFiles()
    assert len({f.rsplit("/", 2)[1] for f in files}) <= 4
    folders = [p.name for p in next((tmp_path / "out").glob("run=*")).iterdir() if p.is_dir()]
    assert len([f for f in folders if f.startswith("base=")]) <= 2 and len(folders) <= 10
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == got
    assert jobs.compact_agent_counts(spark, out) is None or run() == got
