import pytest
from pyspark.sql import functions as F

from groundwork.operators import telemetry
from groundwork.sources.versions import claim_version, complete_versions, publish, read_latest
from groundwork.streaming import jobs

FEED = "id bigint, ts timestamp_ntz, agent string, line string"


def drop(spark, folder, data):
    spark.createDataFrame(data, "id bigint, ts string, agent string, line string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    ).coalesce(1).write.mode("append").parquet(folder)


FIRST = [(1, "2024-01-01 01:00:00", "a", "[Graph Agent] x"), (2, "2024-01-01 02:00:00", "b", "plain")]
SECOND = [(3, "2024-01-01 23:00:00", "a", "[RAG] y"), (4, "2024-01-02 00:00:00", "a", "[x]")]


def test_logs_continue_where_they_stopped(spark, tmp_path, rows):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        jobs.stream_logs(jobs.read_feed(spark, src, FEED), "line", out, state).awaitTermination()

    drop(spark, src, FIRST)
    run()
    assert spark.read.parquet(out).count() == 2
    drop(spark, src, SECOND)
    run()
    run()
    batch = telemetry.classify(telemetry.parse_logs(spark.read.schema(FEED).parquet(src), "line"))
    columns = ["id", "tag", "agent", "message"]
    assert rows(spark.read.parquet(out), *columns) == rows(batch, *columns)


def test_counters_equal_the_batch_result(spark, tmp_path, rows):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for data in (FIRST, SECOND):
        drop(spark, src, data)
        jobs.stream_agent_counts(jobs.read_feed(spark, src, FEED), "ts", "agent", out, state).awaitTermination()
    counts = jobs.read_agent_counts(spark, out)
    found = {(r.window_start.day, r.agent_id): r.invocations for r in counts.collect()}
    assert found == {(1, "a"): 2, (1, "b"): 1, (2, "a"): 1}


def test_counters_over_all_events(spark, tables, tmp_path, rows):
    feed = jobs.read_feed(
        spark, tables.directory, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", "events.parquet"
    )
    out = str(tmp_path / "out")
    jobs.stream_agent_counts(feed, "ts", "user_id", out, str(tmp_path / "state")).awaitTermination()
    assert jobs.read_agent_counts(spark, out).agg(F.sum("invocations")).first()[0] == tables["events"].count() == 1000


CATALOG = "agent_id string, agent_name string, deployment_target string, status string, created_at timestamp_ntz, updated_at timestamp_ntz"


@pytest.fixture
def catalogue(spark, tmp_path):
    root = str(tmp_path / "table")
    old = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    start = spark.createDataFrame([("a", "A", "HYBRID", "DECOMMISSIONED")], "agent_id string, agent_name string, deployment_target string, status string")
    publish(start.withColumn("created_at", old).withColumn("updated_at", old), root, 0)
    return root


def test_upserts_replay_to_the_same_version(spark, tmp_path, catalogue):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "agent_id string, agent_name string, deployment_target string, sent_at int"

    def run(checkpoint):
        feed = jobs.read_feed(spark, src, schema)
        as_of = lambda: F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
        jobs.stream_upsert(feed, catalogue, checkpoint, ["sent_at"], as_of).awaitTermination()

    spark.createDataFrame([("a", "old", None, 1), ("a", "new", None, 2), ("b", "B", "DB_NATIVE", 1)], schema).coalesce(1).write.parquet(src)
    run(state)
    first = {r.agent_id: tuple(r) for r in read_latest(spark, catalogue).collect()}
    assert complete_versions(spark, catalogue) == [0, 1]
    assert first["a"][1] == "new" and first["a"][3] == "ACTIVE" and first["a"][4].year == 2024
    assert first["b"][2] == "DB_NATIVE" and first["b"][4].year == 2025
    # A lost checkpoint reads the feed again, into a version after all others.
    run(str(tmp_path / "state2"))
    assert complete_versions(spark, catalogue) == [0, 1, 2]
    assert {r.agent_id: tuple(r) for r in read_latest(spark, catalogue).collect()} == first
    spark.createDataFrame([("c", "C", None, 1)], schema).coalesce(1).write.mode("append").parquet(src)
    run(state)
    assert complete_versions(spark, catalogue) == [0, 1, 2, 3]
    assert read_latest(spark, catalogue).count() == 3


def test_older_changes_in_later_batches_lose(spark, tmp_path, catalogue):
    schema = "agent_id string, agent_name string, deployment_target string, sent_at int"
    src, as_of = str(tmp_path / "in"), lambda: F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    for sent, name in ((9, "newest"), (1, "stale"), (9, "same time"), (5, "stale too")):
        spark.createDataFrame([("a", name, None, sent), (f"k{sent}", name, None, sent)], schema).coalesce(1).write.mode("append").parquet(src)
        feed = jobs.read_feed(spark, src, schema, per_batch=1)
        jobs.stream_upsert(feed, catalogue, str(tmp_path / "state"), ["sent_at"], as_of).awaitTermination()
    found = {r.agent_id: r.agent_name for r in read_latest(spark, catalogue).collect()}
    assert found == {"a": "same time", "k9": "same time", "k1": "stale", "k5": "stale too"}


def test_a_claimed_version_is_rebuilt_while_it_is_the_newest(spark, catalogue):
    assert claim_version(spark, catalogue, "run-0") == 1
    assert claim_version(spark, catalogue, "run-0") == 1
    publish(read_latest(spark, catalogue), catalogue, 1)
    assert claim_version(spark, catalogue, "run-0") == 1
    assert claim_version(spark, catalogue, "run-1") == 2
    publish(read_latest(spark, catalogue), catalogue, 2)
    assert claim_version(spark, catalogue, "run-0") == 3


def test_counters_take_late_events_replays_and_new_checkpoints(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    days = [[(10 * d + i, f"2024-01-{d:02d} 0{i}:00:00", "ab"[i % 2], "x") for i in range(5)] for d in (20, 9, 2, 1)]
    want = {(d, a): n for d in (1, 2, 9, 20) for a, n in (("a", 3), ("b", 2))}

    def found():
        return {(r.window_start.day, r.agent_id): r.invocations for r in jobs.read_agent_counts(spark, out).collect()}

    def run(checkpoint):
        feed = jobs.read_feed(spark, src, FEED, per_batch=1)
        jobs.stream_agent_counts(feed, "ts", "agent", out, checkpoint).awaitTermination()

    for data in days:
        drop(spark, src, data)
        run(state)
    assert found() == want
    # The last batch again, as after a failure before its commit.
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run(state)
    assert found() == want
    run(str(tmp_path / "state2"))
    assert found() == want
