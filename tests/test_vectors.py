import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from groundwork.errors import DimensionMismatch
from groundwork.functions import vectors as kernels
from groundwork.operators import retrieval, vectors

SCHEMA = "id bigint, embedding array<float>, label int"


def frame(spark, points, labels=None):
    labels = labels or [i % 3 for i in range(len(points))]
    data = [(i, None if p is None else [float(x) for x in p], labels[i]) for i, p in enumerate(points)]
    return spark.createDataFrame(data, SCHEMA)


def queries(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "query_id bigint, embedding array<float>")


def brute(points, query, k, metric, skip=None):
    usable = [(i, np.array(p, dtype=np.float32).astype(float)) for i, p in enumerate(points) if p is not None and i != skip]
    q = np.array(query, dtype=np.float32).astype(float)
    if metric == vectors.DOT:
        scored = [(round(-float(v @ q), 9) + 0.0, i) for i, v in usable]
    else:
        norm = [(v, np.linalg.norm(v) * np.linalg.norm(q), i) for i, v in usable]
        scored = [(round(1 - float(v @ q) / n, 9) + 0.0, i) for v, n, i in norm if n > 0]
    return [i for _, i in sorted(scored)[:k]]


RNG = np.random.default_rng(7)
POINTS = [list(v) for v in RNG.normal(size=(300, 6)) * RNG.uniform(0.2, 5, size=(300, 1))]


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_single_query_equals_brute_force(spark, metric):
    df = frame(spark, POINTS).repartition(5)
    found = vectors.vector_topk(df, POINTS[3], 9, metric).collect()
    assert [r.id for r in found] == brute(POINTS, POINTS[3], 9, metric)
    assert [r.distance for r in found] == sorted(r.distance for r in found)


def test_metrics_differ_on_unscaled_vectors():
    assert brute(POINTS, POINTS[3], 9, vectors.DOT) != brute(POINTS, POINTS[3], 9, vectors.COSINE)


def test_smallest_distance_is_the_largest_product(spark):
    df = frame(spark, [[1, 0], [3, 0], [2, 0], [-1, 0]])
    assert [(r.id, r.distance) for r in vectors.vector_topk(df, [1, 0], 2).collect()] == [(1, -3.0), (2, -2.0)]


def test_ties_nulls_and_zero_norms(spark):
    df = frame(spark, [[0, 1], None, [0, 1], [0, 0], [0, 1], [1, 0]])
    assert [r.id for r in vectors.vector_topk(df, [0, 2], 2).collect()] == [0, 2]
    assert [r.id for r in vectors.vector_topk(df, [0, 2], 10, vectors.COSINE).collect()] == [0, 2, 4, 5]
    assert vectors.vector_topk(df.limit(0), [0, 2]).count() == 0


def test_top_k_plan_has_no_full_sort(spark, plan):
    text = plan(vectors.vector_topk(frame(spark, POINTS), POINTS[0]))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_wrong_dimension_raises(spark):
    df = frame(spark, [[1, 2], [1, 2, 3]])
    with pytest.raises(PySparkException):
        vectors.vector_topk(df, [1, 2]).collect()
    with pytest.raises(DimensionMismatch):
        vectors.vector_topk_batch(df, queries(spark, [[1, 2], [1, 2, 3]]))
    with pytest.raises(ValueError):
        vectors.vector_topk(df, [1, 2], metric="manhattan")
    with pytest.raises(PySparkException):
        vectors.check_dims(df, "embedding", 2).collect()
    assert [(r.id, r.dims) for r in vectors.dim_offenders(df, "id", "embedding", 2).collect()] == [(1, 3)]
    report = {r.dims: (r.n_rows, r.fits) for r in vectors.dim_report(df, "embedding", 2).collect()}
    assert report == {2: (1, True), 3: (1, False)}


@pytest.mark.parametrize("metric", vectors.METRICS)
@pytest.mark.parametrize("skip_self", [False, True])
def test_batch_equals_single_both_ways(spark, monkeypatch, metric, skip_self):
    df, asked = frame(spark, POINTS).repartition(4), queries(spark, POINTS[:40])

    def ranked():
        near = vectors.vector_topk_batch(df, asked, 4, metric, skip_self).collect()
        by_query = {}
        for r in sorted(near, key=lambda r: r["rank"]):
            by_query.setdefault(r.query_id, []).append(r.id)
        return by_query

    expected = {q: brute(POINTS, POINTS[q], 4, metric, q if skip_self else None) for q in range(40)}
    assert ranked() == expected
    # Beyond the broadcast bound, in many small blocks.
    monkeypatch.setattr(vectors, "MAX_BROADCAST_QUERIES", 5)
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", 37)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 11)
    assert ranked() == expected


def test_no_queries(spark):
    near = vectors.vector_topk_batch(frame(spark, POINTS), queries(spark, POINTS).limit(0))
    assert near.count() == 0 and near.columns == ["query_id", "id", "distance", "rank"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=40), st.integers(1, 8))
def test_nearest_breaks_ties_by_id(values, k):
    ids = np.arange(len(values))[::-1].copy()
    column = np.array(values, dtype=float)
    expected = sorted(range(len(values)), key=lambda i: (column[i], ids[i]))[:k]
    assert kernels.nearest(ids, column, k).tolist() == expected


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    corpus = tables["embeddings"].selectExpr("vec_id AS id", "embedding", "label")
    return corpus, vectors.build_ivf(corpus, str(tmp_path_factory.mktemp("ivf")), cells=16)


def test_index_holds_every_row_once(spark, index):
    corpus, path = index
    assert spark.read.parquet(f"{path}/cells").count() == corpus.count()
    assert spark.read.parquet(f"{path}/centers").count() == 16


@pytest.mark.parametrize("bound", [4096, 10])
def test_index_recall(spark, index, monkeypatch, bound):
    """Every vector's five neighbours: at least 95% found in 12 of 16 cells, all in 16 of 16."""
    monkeypatch.setattr(vectors, "MAX_BROADCAST_QUERIES", bound)
    corpus, path = index
    everything = corpus.selectExpr("id AS query_id", "embedding")
    exact = vectors.vector_topk_batch(corpus, everything, 5, skip_self=True)
    some = vectors.recall(vectors.ivf_topk(spark, path, everything, 5, 12, skip_self=True), exact).first()
    assert some.n_exact == 2500 and some.recall >= 0.95
    whole = vectors.recall(vectors.ivf_topk(spark, path, everything, 5, 16, skip_self=True), exact).first()
    assert whole.recall == 1.0


def test_probes_meet_their_target(spark, index):
    corpus, path = index
    everything = corpus.selectExpr("id AS query_id", "embedding")
    exact = vectors.vector_topk_batch(corpus, everything, 5)
    probes = {target: vectors.probes_for(spark, path, everything, 5, target) for target in (0.6, 0.95, 1.0)}
    assert 1 <= probes[0.6] < probes[0.95] <= probes[1.0] <= 16
    for target, nprobe in probes.items():
        reached = vectors.recall(vectors.ivf_topk(spark, path, everything, 5, nprobe), exact).first()
        assert reached.n_found >= target * reached.n_exact
    fewer = vectors.recall(vectors.ivf_topk(spark, path, everything, 5, probes[0.95] - 1), exact).first()
    assert fewer.n_found < 0.95 * fewer.n_exact


def test_index_prunes_directories(spark, index, tables):
    _, path = index
    one = tables["embeddings"].where("vec_id = 3").selectExpr("vec_id AS query_id", "embedding")
    near = vectors.ivf_topk(spark, path, one, 5, nprobe=2)
    files = near.inputFiles()
    assert files and len({f.split("cell=")[1].split("/")[0] for f in files}) <= 16
    assert "PartitionFilters: [cell" in near._jdf.queryExecution().toString().replace("isnotnull(cell), ", "")


def test_label_vote(spark):
    history = frame(spark, [[1, 0], [0.9, 0], [0.8, 0], [0, 1]], [5, 7, 7, 1])
    live = queries(spark, [[1, 0], [0, 1]])
    voted = {r.query_id: (r.label, r.votes) for r in vectors.knn_label_vote(live, history, 3).collect()}
    assert voted[0] == (7, 2)
    tie = {r.query_id: r.label for r in vectors.knn_label_vote(live, history, 2).collect()}
    # One vote each: the labels' distances are -1 and -0.9.
    assert tie[0] == 5


def test_remaining_life_weighs_near_histories_more(spark):
    history = spark.createDataFrame([(0, [1.0, 0.0], 100.0), (1, [0.0, 1.0], 0.0)], "id bigint, embedding array<float>, life double")
    estimate = vectors.rul_estimate(queries(spark, [[1, 0]]), history, 2).first()
    assert estimate.neighbours == 2
    assert estimate.remaining == pytest.approx(100 * 1 / (1 + 0.5), abs=1e-3)


def test_context_lists_chunks_in_order(spark):
    corpus = frame(spark, [[1, 0], [3, 0], [2, 0]])
    contents = spark.createDataFrame([(0, "zero"), (1, "one")], "id bigint, content string")
    asked = queries(spark, [[1, 0]])
    row = retrieval.rag_context(corpus, contents, asked, 2).first()
    assert row.context == "[Context 1]: one\n\n[Context 2]: "
    assert (row.n_chunks, row.source_note) == (2, "[Source: 2 chunks]")
    none = retrieval.rag_context(corpus.limit(0), contents, asked, 2).first()
    assert (none.context, none.n_chunks, none.source_note) == ("", 0, "[Source: 0 chunks]")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="aé 文\n", max_size=70), min_size=1, max_size=5), st.integers(2, 12), st.data())
def test_chunks_cover_the_whole_text(spark, texts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {}
    for r in retrieval.chunk_documents(df, "doc_id", "text", size, overlap).collect():
        found.setdefault(r.doc_id, {})[r.chunk_no] = r.chunk
    for i, text in enumerate(texts):
        chunks = [c for _, c in sorted(found.get(i, {}).items())]
        assert "".join(c if n == 0 else c[overlap:] for n, c in enumerate(chunks)) == text
        assert all(len(c) == size for c in chunks[:-1]) and all(len(c) > overlap for c in chunks[1:])
    with pytest.raises(ValueError):
        retrieval.chunk_documents(df, "doc_id", "text", 5, 5)
