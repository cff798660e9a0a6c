import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from groundwork.errors import TableNotFound
from groundwork.functions import vectors as kernels
from groundwork.operators import vectors
from groundwork.operators.vector_index import VectorIndex, _first_place, _place, build
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def corpus(tables):
    return tables["embeddings"].selectExpr("vec_id AS id", "embedding")


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    made = build(corpus.where("id < 400"), str(tmp_path_factory.mktemp("index")), cells=16)
    made.append(corpus.where("id >= 400"))
    made.calibrate(5, 0.97)
    return made


def asked(corpus, condition="true"):
    return corpus.where(condition).selectExpr("id AS query_id", "embedding")


def test_every_row_is_in_one_or_two_cells(index, corpus):
    rows = index.rows().groupBy("id").count().groupBy("count").count().collect()
    assert {r[0] for r in rows} == {1, 2} and sum(r[1] for r in rows) == corpus.count()
    assert index.rows().where("id >= 400").select("part").distinct().count() == 1


@pytest.mark.parametrize("bound", [4096, 10])
def test_all_cells_are_exact_and_give_no_row_twice(index, corpus, monkeypatch, bound):
    monkeypatch.setattr(vectors, "MAX_BROADCAST_QUERIES", bound)
    queries = asked(corpus, "id % 9 = 0")
    got = index.search(queries, 5, nprobe=16, skip_self=True)
    want = vectors.vector_topk_batch(corpus, queries, 5, skip_self=True)
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("condition", ["pmod(xxhash64(id), 10) <> 0", "id >= 400"])
def test_recall_of_queries_that_calibrated_nothing(index, corpus, condition):
    queries = asked(corpus, condition + " AND pmod(xxhash64(id), 10) <> 0")
    exact = vectors.vector_topk_batch(corpus, queries, 5, skip_self=True)
    found = vectors.recall(index.search(queries, 5, skip_self=True), exact).first()
    assert found.n_exact > 300 and found.recall >= 0.95
    assert index.nprobe() < 16


def test_a_later_session_finds_the_index_and_reads_probed_cells_only(spark, index, corpus):
    again = VectorIndex(spark, index.folder)
    assert again.exists() and again.nprobe() == index.nprobe()
    found = again.search(asked(corpus, "id = 3"), 5, nprobe=2)
    assert found.count() == 5
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    probed = {f.split("cell=")[1].split("/")[0] for f in again.rows().where("cell IN (1, 2)").inputFiles()}
    assert len(probed) >= 2
    assert "KMeans" not in plan_of(found)


def test_failed_appends_are_invisible_and_bad_calls_refused(spark, index, corpus, tmp_path):
    before = index.rows().count()
    (index_path := __import__("pathlib").Path(index.folder) / "rows" / "part=999999-x" / "cell=0").mkdir(parents=True)
    assert index.rows().count() == before and index_path.exists()
    with pytest.raises(ValueError):
        build(corpus, index.folder)
    with pytest.raises(TableNotFound):
        VectorIndex(spark, str(tmp_path / "none")).search(asked(corpus), 5)
    with pytest.raises(ValueError):
        build(corpus.limit(0), str(tmp_path / "empty"))
    assert index.search(asked(corpus, "false"), 5).count() == 0


def test_repeated_vectors(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)] + [(99, None)], "id bigint, embedding array<float>")
    made = build(same, str(tmp_path / "one"), cells=2)
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    assert [r.id for r in made.search(query, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert np.isclose(made.search(query, 3).first().distance, -1)


def test_a_batch_meets_many_cells_in_bounded_memory():
    pick = np.random.default_rng(2)
    rows, centers = pick.normal(size=(4000, 4)), pick.normal(size=(3000, 4))
    vectors_ = pa.array(rows.tolist(), pa.list_(pa.float64()))
    batch = pa.record_batch([pa.array(range(4000)), vectors_], ["id", "embedding"])
    placed = pa.record_batch([vectors_, pa.array([[7]] * 4000, pa.list_(pa.int32()))], ["embedding", "cells"])
    runs = [(_place(centers, 0.0), batch), (_first_place(centers), placed), (kernels.probe_cells(centers, 2), batch)]
    results = []
    for run, given in runs:
        tracemalloc.start()
        results.append(pa.Table.from_batches(list(run(iter([given])))))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 90 << 20  # all gaps at once are 96 MB, and so is their order
    gaps = ((rows[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    assert results[0].column("id").to_pylist() == list(range(4000))
    assert results[0].column("cell").to_pylist() == gaps.argmin(axis=1).tolist()
    order = np.argsort(-(rows @ centers.T), axis=1, kind="stable")
    assert results[1].column("place").to_pylist() == (np.argmax(order == 7, axis=1) + 1).tolist()
    assert results[2].column("cell").to_pylist() == order[:, :2].ravel().tolist()
