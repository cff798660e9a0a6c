"""Every registered query against its SQL twin on the smallest tables, and plan rules."""

import inspect

import pytest

import __spark_entry__ as entry
from check_sql import compare, database
from groundwork.plans import QUERIES, SQL
from tests.conftest import SMALL, plan_of

ROWS_ONLY = {"vector_ivf_topk", "ivf_recall", "graph_index_recall"}


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    verdict, _ = compare(spark, con, name, SMALL)
    assert verdict.startswith("ok"), verdict


def test_only_index_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_the_flagship_rows(spark):
    result = entry.entry(spark)
    assert result.columns == ["id", "distance"]
    assert result.count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_every_row_with_every_row(spark, name):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(entry.queries()[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_library_never_uses_local_checkpoints_or_rdds():
    import pkgutil
    from importlib import import_module

    import groundwork

    for module in pkgutil.walk_packages(groundwork.__path__, "groundwork."):
        source = inspect.getsource(import_module(module.name))
        assert "localCheckpoint" not in source
        assert ".rdd" not in source
        assert "crossJoin" not in source


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """Workers started in another folder, where the package cannot be imported."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    script = f"""
import sys; sys.path.insert(0, {str(root)!r})
import __spark_entry__ as entry
from groundwork.session import build
spark = build(master="local[2]", spark_ui_enabled="false", spark_sql_shuffle_partitions="2")
queries = entry.queries()
print(len(queries["distinct_fuzzy"](spark, {SMALL!r}).collect()), entry.entry(spark).count())
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.split()[-2:] == ["4", "5"], done.stderr[-2000:]


@pytest.fixture(scope="module")
def split_tables(spark, tmp_path_factory):
    """The same tables as directories of several files, rows in another order."""
    folder = tmp_path_factory.mktemp("split")
    for name in ("customer", "supplier", "nation", "events", "embeddings", "documents", "conversations", "orders"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(5).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [
        "stream_logs", "stream_agent_counts", "stream_upsert", "run_sql_capped", "result_envelope", "metrics_json",
        "vector_topk_batch", "search_documents", "rag_context", "trace_final", "logs_last_500", "distinct_capped", "merge_dedup",
    ],
)
def test_query_on_many_files(spark, con, split_tables, name):
    verdict, _ = compare(spark, con, name, split_tables)
    assert verdict == "ok"
