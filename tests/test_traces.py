import random

import pytest
from pyspark.sql import functions as F

from groundwork.streaming import jobs, traces

STEPS = "execution_id string, step bigint, at timestamp, result string, failed boolean"


def step(name, number, second, result=None, failed=False):
    return (name, number, second, result, failed)


ROWS = (
    [step("a", i, i, f"r{i}" if i % 2 else None) for i in range(4)]
    + [step("b", 0, 1), step("b", 1, 2, "done"), step("b", 2, 3)]
    + [step("c", 0, 5, "x"), step("c", 1, 6, None, True), step("c", 2, 7, "y")]
    + [step("d", 0, 1, ""), step("d", 0, 2, "twin"), step("d", 0, 2, "twin again")]
    + [step("e", 3, 9, None, None)]
)


def drop(spark, folder, rows):
    df = spark.createDataFrame([(n, s, float(at), r, f) for n, s, at, r, f in rows], STEPS.replace("at timestamp", "at double"))
    df.withColumn("at", F.timestamp_seconds(F.col("at") + 1_000_000)).coalesce(1).write.mode("append").parquet(folder)


def found(spark, out):
    return sorted(tuple(r) for r in traces.read_traces(spark, out).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_live_traces_equal_the_batch_for_any_order_and_survive_restarts(spark, tmp_path, seed):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    mixed = list(ROWS)
    random.Random(seed).shuffle(mixed)
    for at in range(0, len(mixed), 5):
        drop(spark, src, mixed[at : at + 5])
        # Every call is a new query on the same checkpoint.
        traces.stream_traces(jobs.read_feed(spark, src, STEPS, per_batch=1), out, state).awaitTermination()
    want = sorted(tuple(r) for r in traces.batch_traces(spark.read.schema(STEPS).parquet(src)).collect())
    assert found(spark, out) == want
    assert {r[0]: r[1] for r in want} == {"a": "completed", "b": "processing", "c": "error", "d": "completed", "e": "processing"}


def test_stalled_executions_are_reported_until_their_next_step(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(rows):
        drop(spark, src, rows)
        feed = jobs.read_feed(spark, src, STEPS, per_batch=1)
        traces.stream_traces(feed, out, state, stalled_after=60, late="1 hour").awaitTermination()
        return {r[0]: r[1] for r in found(spark, out)}

    assert run([step("a", 0, 0), step("b", 0, 0, "r")]) == {"a": "processing", "b": "completed"}
    assert run([step("z", 0, 10_000, "r")]) == {"a": "stalled", "b": "completed", "z": "completed"}
    assert run([step("a", 1, 9_000)])["a"] == "processing"
    assert run([step("a", 2, 9_500, "end")])["a"] == "completed"


def test_no_batches(spark, tmp_path):
    assert traces.read_traces(spark, str(tmp_path / "none")).count() == 0


def test_raw_lines_arrive_once_after_a_failed_batch(spark, tmp_path):
    src, out, state = (tmp_path / n for n in ("in", "out", "state"))
    src.mkdir()

    def run():
        jobs.stream_logs(jobs.read_lines(spark, str(src), "*.log", per_batch=1), "line", str(out), str(state)).awaitTermination()

    (src / "one.log").write_text("[Graph Agent] x\nplain\n")
    (src / "skipped.txt").write_text("not a log\n")
    run()
    (src / "two.log").write_text("[RAG] y\n[x]\n")
    run()
    last = max((state / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    rows = sorted((r.line, r.agent, r.message) for r in spark.read.parquet(str(out)).collect())
    assert [r[0] for r in rows] == ["[Graph Agent] x", "[RAG] y", "[x]", "plain"]
    assert rows[0][1:] == ("Graph Agent", "x")
