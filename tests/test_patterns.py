import random

import pytest
from pyspark.sql import functions as F

from groundwork.operators.patterns import Hop, Node, match
from groundwork.operators.profiling import footer_bounds, range_from_footers
from groundwork.errors import UnsupportedColumnType
from tests.conftest import SMALL, plan_of

VERTICES = [(f"v{i}", "ABC"[i % 3], i) for i in range(18)]


def edges(seed):
    pick = random.Random(seed)
    return [(f"v{pick.randrange(18)}", f"v{pick.randrange(18)}", pick.randrange(10)) for _ in range(40)] + [("v1", "v1", 5), ("v1", "v2", 5), ("v1", "v2", 6), ("v0", "missing", 1)]


@pytest.fixture
def graph(spark):
    rows = edges(2)
    return rows, spark.createDataFrame(VERTICES, "id string, label string, size int"), spark.createDataFrame(rows, "src string, dst string, w int")


def test_single_hops_match_brute_force(graph):
    rows, vertex, edge = graph
    found = match(vertex, edge, [Node("a", "A"), Hop("x", F.col("w") > 2), Node("b", "B"), Hop("y"), Node("c", where=F.col("size") < 12)])
    label, size = {i: x for i, x, _ in VERTICES}, {i: s for i, _, s in VERTICES}
    want = sorted(
        (s, d, e, w, u)
        for s, d, w in rows
        for m, e, u in rows
        if m == d and w > 2 and label.get(s) == "A" and label.get(d) == "B" and size.get(e, 99) < 12
    )
    got = sorted(tuple(r) for r in found.select("a", "b", "c", "x.w", F.col("y.w").alias("u")).collect())
    assert got == want and want


def test_repeated_hops_match_brute_force_and_end_in_cycles(graph):
    rows, vertex, edge = graph
    found = match(vertex, edge, [Node("a", "A"), Hop("n", least=2, most=5), Node("b", "C")])
    label, links = {i: x for i, x, _ in VERTICES}, {(s, d) for s, d, _ in rows}
    walks, want = links, set()
    for n in range(1, 6):
        if n > 1:
            walks = {(a, d) for a, b in walks for s, d in links if s == b}
        if n >= 2:
            want |= {(a, n, b) for a, b in walks if label.get(a) == "A" and label.get(b) == "C"}
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and want


def test_one_node_no_match_and_bad_patterns(graph):
    _, vertex, edge = graph
    assert match(vertex, edge, [Node("a", "B")]).count() == 6
    assert match(vertex, edge, [Node("a", "Z"), Hop("x"), Node("b")]).count() == 0
    for bad in ([Node("a"), Hop("x")], [Node("a"), Node("b"), Hop("x")], [Node("a"), Hop("x"), Node("a")], [Node("a"), Hop("x", most=99), Node("b")], [Node("a"), Hop("x", least=0), Node("b")]):
        with pytest.raises(ValueError):
            match(vertex, edge, bad)


def test_patterns_never_pair_everything(spark, graph):
    _, vertex, edge = graph
    plan = plan_of(match(vertex, edge, [Node("a", "A"), Hop("x"), Node("b", "B"), Hop("y"), Node("c")]))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "LeftSemi" in plan


def test_footers_answer_without_reading_a_column(spark):
    path = f"{SMALL}/part.parquet"
    plan = footer_bounds(spark, path, "p_retailprice")._jdf.queryExecution().toString()
    assert "PushedAggregation: [MIN(p_retailprice), MAX(p_retailprice)]" in plan
    assert range_from_footers(spark, path, "p_size").first().min_value >= 1
    with pytest.raises(UnsupportedColumnType):
        range_from_footers(spark, path, "p_name")
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""
