import json
import random

import pytest
from pyspark.sql import functions as F

from groundwork.operators import charts, graph, inventory

EDGE = "src string, dst string, transit_days double, cost double, risk double"


def edges(spark, *links):
    return spark.createDataFrame([(s, d, *(figures or (1.0, 1.0, 0.1))) for s, d, *figures in links], EDGE)


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "start string")


def test_vertices_carry_their_label(spark, rows):
    a = spark.createDataFrame([("S:1", "x")], "id string, name string")
    b = spark.createDataFrame([("P:1", "y")], "id string, name string")
    assert rows(graph.vertices({"Supplier": a, "Plant": b})) == [("P:1", "Plant", "y"), ("S:1", "Supplier", "x")]


def test_dangling_reports_each_missing_end(spark, rows):
    vertex = spark.createDataFrame([("a",), ("b",)], "id string")
    found = graph.dangling(vertex, edges(spark, ("a", "b"), ("a", "x"), ("y", "z")))
    assert rows(found) == [("a", "x", "dst"), ("y", "z", "dst"), ("y", "z", "src")]


def test_neighbors_by_list_and_frame(spark, rows):
    edge = edges(spark, ("a", "b"), ("a", "c"), ("b", "c"))
    vertex = spark.createDataFrame([("b", "Port", "B"), ("c", "Port", "C")], "id string, label string, name string")
    assert rows(graph.neighbors(edge, ["a"]), "src", "dst") == [("a", "b"), ("a", "c")]
    named = graph.neighbors(edge, starts(spark, "a", "a"), vertex)
    assert rows(named, "dst", "name") == [("b", "B"), ("c", "C")]


def test_khop_ends_on_cycles_and_keeps_the_shortest(spark, rows):
    edge = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e"), ("b", "b"))
    assert rows(graph.khop(edge, starts(spark, "a"), 2)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2)]
    assert rows(graph.khop(edge, starts(spark, "a"), 50))[-1] == ("a", "e", 3)
    assert rows(graph.khop(edge, starts(spark, "e", "zz"), 3)) == [("e", "e", 0), ("zz", "zz", 0)]


def _random_graph(seed):
    rng = random.Random(seed)
    return [(f"v{rng.randrange(12)}", f"v{rng.randrange(12)}", float(rng.randrange(1, 9)), float(rng.randrange(5)), rng.random()) for _ in range(40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_traversals_equal_brute_force(spark, seed):
    links = _random_graph(seed)
    edge = spark.createDataFrame(links, EDGE)
    ids = ["v0", "v5"]
    hops, totals = {}, {}
    for start in ids:
        hops[(start, start)] = 0
        paths = {start: {(0.0, 0.0, 0.0, 0)}}
        for hop in range(1, 4):
            onward = {}
            for vertex, found in paths.items():
                for s, d, t, c, r in links:
                    if s == vertex:
                        onward.setdefault(d, set()).update((a + t, b + c, max(m, r), hop) for a, b, m, _ in found)
            for vertex, found in onward.items():
                hops.setdefault((start, vertex), hop)
                if vertex != start:
                    best = totals.get((start, vertex))
                    totals[(start, vertex)] = min(found | ({best} if best else set()))
            paths = onward
    assert {(r.start, r.id): r.hops for r in graph.khop(edge, starts(spark, *ids), 3).collect()} == hops
    found = {(r.start, r.id): (r.transit_days, r.cost, r.max_risk, r.hops) for r in graph.path_totals(edge, starts(spark, *ids), 3).collect()}
    # Quickest in days and cost; risk and hops only break ties between equal paths kept per hop.
    assert {k: v[:2] for k, v in found.items()} == {k: v[:2] for k, v in totals.items()}


def _supply(spark):
    return spark.createDataFrame(
        [("SKU-1", "S:1", "P:A", "R:0", "W:X"), ("SKU-1", "S:1", "P:A", "R:0", "W:Y"), ("SKU-2", "S:2", "P:B", "R:0", "W:X")],
        "sku string, supplier string, plant string, port string, warehouse string",
    )


def test_dependency_of_one_sku(spark, rows):
    chain = graph.sku_dependency(_supply(spark), "SKU-1")
    assert rows(chain, "tier", "src", "dst") == [(1, "S:1", "P:A"), (2, "P:A", "R:0"), (3, "R:0", "W:X"), (3, "R:0", "W:Y")]
    assert graph.sku_dependency(_supply(spark), "SKU-404").count() == 0


def test_bottlenecks_need_an_active_disruption_on_the_path(spark, rows):
    vertex = spark.createDataFrame([("P:A", "Plant", "A"), ("R:0", "Port", "Bay"), ("W:X", "Warehouse", "X")], "id string, label string, name string")
    disruptions = spark.createDataFrame(
        [("A", "Strike", "HIGH", 0.7, "Y", 5.0), ("X", "Flood", "LOW", 0.1, "N", 1.0), ("Elsewhere", "Fog", "LOW", 0.1, "Y", 1.0)],
        "location_name string, disruption_type string, severity string, impact_score double, active_flag string, delay_days double",
    )
    found = graph.bottlenecks(graph.sku_dependency(_supply(spark)), vertex, disruptions)
    assert rows(found, "sku", "id", "disruption_type", "delay_days") == [("SKU-1", "P:A", "Strike", 5.0)]


STOCK = [("A", "north", 120), ("A", "south", 1850), ("A", "east", 1850), ("A", "west", 299), ("B", "north", 300), ("B", "south", 10)]


def _stock(spark):
    return spark.createDataFrame(STOCK, "sku string, warehouse string, on_hand bigint")


def test_stockout_class(spark):
    risk = {(r.sku, r.warehouse): r.risk_status for r in inventory.stockout_risk(_stock(spark)).collect()}
    assert risk[("A", "north")] == "CRITICAL_STOCKOUT" and risk[("B", "north")] == "OK"
    assert sum(v == "CRITICAL_STOCKOUT" for v in risk.values()) == 3


def test_stock_split_over_rows_is_summed(spark):
    split = spark.createDataFrame([("A", "n", 200), ("A", "n", 200)], "sku string, warehouse string, on_hand bigint")
    assert inventory.stockout_risk(split).first().on_hand == 400


def test_relief_comes_from_the_largest_surplus(spark, rows):
    relief = inventory.relief_source(_stock(spark))
    assert rows(relief, "sku", "destination", "deficit", "source", "surplus") == [
        ("A", "north", 180, "east", 1550), ("A", "west", 1, "east", 1550),
    ]


def _routes(spark):
    return spark.createDataFrame(
        [(1, "east", "north", "SEA", 9.0, 1.0, 0.1), (2, "east", "north", "RAIL", 2.5, 9.0, 0.1), (3, "east", "north", "TRUCK", 2.5, 9.0, 0.1), (4, "east", "north", "AIR", None, 0.0, 0.0)],
        "route_id int, origin string, destination string, transport_mode string, transit_days double, cost_per_ton double, risk_factor double",
    )


def test_best_route(spark):
    best = inventory.best_route(_routes(spark)).collect()
    assert [(r.route_id, r.transport_mode) for r in best] == [(2, "RAIL")]


def test_transfer_drafts(spark):
    drafts = {r.destination: r for r in inventory.transfer_drafts(_stock(spark), _routes(spark)).collect()}
    assert drafts["north"].draft_action_id == "draft-transfer-a-east-north"
    assert (drafts["north"].units, drafts["north"].route_id, drafts["north"].requires_approval) == (180, 2, True)
    assert drafts["west"].route_id is None and drafts["west"].action_type == "INVENTORY_TRANSFER"


def test_allocation_promises_no_unit_twice(spark):
    import random
    from collections import Counter

    draw = random.Random(4)
    cells = [(f"s{k}", f"w{w:02d}", draw.choice([0, 50, 90, 100, 101, 130, 180, 400])) for k in range(40) for w in range(12)]
    stock = spark.createDataFrame(cells, "sku string, warehouse string, on_hand bigint")
    given, taken = Counter(), Counter()
    for r in inventory.allocate(stock, 100).collect():
        assert r.units > 0
        given[r.sku, r.source] += r.units
        taken[r.sku, r.destination] += r.units
    for k in range(40):
        own = {w: n for s, w, n in cells if s == f"s{k}"}
        spare, lack = sum(max(n - 100, 0) for n in own.values()), sum(max(100 - n, 0) for n in own.values())
        assert sum(n for (s, _), n in taken.items() if s == f"s{k}") == min(spare, lack)
        assert all(given[f"s{k}", w] <= max(n - 100, 0) and taken[f"s{k}", w] <= max(100 - n, 0) for w, n in own.items())


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_some_cells_are_short_at_every_size(spark, scale):
    from groundwork.plans import QUERIES

    folder = f"/root/testdata/{scale}"
    status = {r.risk_status for r in QUERIES["stockout_risk"](spark, folder).collect()}
    assert status == {"OK", "CRITICAL_STOCKOUT"}
    assert not QUERIES["relief_source"](spark, folder).isEmpty()


def test_unknown_transit_is_not_the_quickest(spark):
    edge = spark.createDataFrame(
        [("a", "b", None, 1.0, 0.1), ("a", "b", 4.0, 9.0, 0.1), ("a", "c", 1.0, 1.0, 0.1), ("c", "d", None, 1.0, 0.1), ("b", "d", 3.0, 1.0, 0.1)],
        "src string, dst string, transit_days double, cost double, risk double",
    )
    found = {r.id: r.transit_days for r in graph.path_totals(edge, starts(spark, "a"), 2).collect()}
    assert found == {"b": 4.0, "c": 1.0, "d": 7.0}


def test_chart_colours_repeat(spark):
    df = spark.createDataFrame([(f"l{i:02d}", i) for i in range(30)], "label string, n int")
    dataset = charts.chart_dataset(df, "label", F.sum("n"), max_labels=25).orderBy("position").collect()
    assert [r.label for r in dataset[:2]] == ["l29", "l28"] and len(dataset) == 26
    assert (dataset[25].label, dataset[25].value) == ("(others)", sum(range(5)))
    every = charts.chart_dataset(df, "label", F.sum("n")).collect()
    assert sorted(r.position for r in every) == list(range(1, 31))
    line = charts.chart_dataset(df, "label", F.sum("n"), kind="line").orderBy("position").collect()
    assert [r.label for r in line] == [f"l{i:02d}" for i in range(30)]
    with pytest.raises(ValueError):
        charts.chart_dataset(df, "label", F.sum("n"), kind="bubble")
    assert dataset[20].colour == dataset[0].colour == charts.PALETTE[0]
    with pytest.raises(ValueError):
        charts.chart_dataset(df, "label", F.sum("n"), kind="sankey")


def test_chart_json(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "label string, n int")
    chart = json.loads(charts.chart_json(charts.chart_dataset(df, "label", F.sum("n")), "T").first().chart_json)
    assert chart["data"]["labels"] == ["b", "a"] and chart["data"]["datasets"][0]["data"] == [2, 1]
    assert chart["type"] == "bar" and chart["options"]["plugins"]["title"]["text"] == "T"
    assert chart["data"]["datasets"][0]["borderWidth"] == 1
    empty = json.loads(charts.chart_json(charts.chart_dataset(df.limit(0), "label", F.sum("n")), "T").first().chart_json)
    assert empty["data"]["labels"] == []
