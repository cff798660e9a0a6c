import tracemalloc

import numpy as np
import pytest

from groundwork.operators import vectors
from groundwork.operators.graph_index import GraphIndex, build_graph, graph_of


def frame(spark, points, parts=4):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id bigint, embedding array<float>").repartition(parts)


def asked(df):
    return df.selectExpr("id AS query_id", "embedding")


def reached(starts, links, entries):
    seen, stack = set(entries), list(entries)
    while stack:
        v = stack.pop()
        for other in links[starts[v] : starts[v + 1]].tolist():
            if other not in seen:
                seen.add(other)
                stack.append(other)
    return seen


@pytest.mark.parametrize("metric", vectors.METRICS)
@pytest.mark.parametrize("kind", ["spread", "clusters", "copies", "one", "zeros"])
def test_every_vector_is_reached(metric, kind):
    pick = np.random.default_rng(3)
    points = {
        "spread": pick.normal(size=(300, 8)),
        "clusters": np.concatenate([pick.normal(size=(150, 8)) * 0.01 + 10 * i for i in range(3)]),
        "copies": np.repeat(pick.normal(size=(3, 8)), 120, axis=0),
        "one": pick.normal(size=(1, 8)),
        "zeros": np.zeros((200, 8)),
    }[kind]
    starts, links, entries = graph_of(points, metric)
    assert reached(starts, links, entries) == set(range(len(points)))
    assert not any(v in links[starts[v] : starts[v + 1]] for v in range(len(points)))


def test_a_shard_never_holds_all_its_distances():
    points = np.random.default_rng(9).normal(size=(2048, 16))
    tracemalloc.start()
    starts, links, entries = graph_of(points, vectors.DOT)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert reached(starts, links, entries) == set(range(2048))
    assert peak < 25 << 20  # all pairs in float32 alone are 16 MB, their order 32 MB


@pytest.mark.parametrize("metric", vectors.METRICS)
@pytest.mark.parametrize("bound", [4096, 10])
def test_recall_against_exact_search(spark, tmp_path, monkeypatch, metric, bound):
    monkeypatch.setattr(vectors, "MAX_BROADCAST_QUERIES", bound)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 70)
    pick = np.random.default_rng(5)
    points = pick.normal(size=(3000, 24)) * pick.uniform(0.5, 2, size=(3000, 1))
    corpus = frame(spark, points)
    index = build_graph(corpus, str(tmp_path / "graph"), metric, shard_rows=1000)
    queries = asked(corpus.where("id % 20 = 0"))
    exact = vectors.vector_topk_batch(corpus, queries, 10, metric, skip_self=True)
    again = GraphIndex(spark, index.folder).search(queries, 10, skip_self=True)
    found = vectors.recall(again, exact).first()
    assert found.n_exact == 1500 and found.recall >= 0.95
    assert again.groupBy("query_id").count().where("count <> 10").count() == 0


def test_wide_searches_are_exact_and_edges_defined(spark, tmp_path):
    corpus = frame(spark, np.random.default_rng(7).normal(size=(400, 6)))
    index = build_graph(corpus, str(tmp_path / "graph"))
    queries = asked(corpus.where("id < 20"))
    assert sorted(index.search(queries, 5, width=400).collect()) == sorted(vectors.vector_topk_batch(corpus, queries, 5).collect())
    assert index.search(queries.limit(0), 5).count() == 0
    empty = build_graph(corpus.limit(0), str(tmp_path / "empty"))
    assert empty.search(queries, 5).count() == 0
    with pytest.raises(Exception, match="components"):
        index.search(spark.createDataFrame([(1, [1.0])], "query_id bigint, embedding array<float>"), 2).collect()
    with pytest.raises(ValueError):
        build_graph(corpus, str(tmp_path / "x"), "manhattan")
