"""Supply-chain graph, inventory, routes and charts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.operators import charts, graph, inventory, patterns, quantiles
from groundwork.operators.patterns import Hop, Node
from groundwork.plans import domain
from groundwork.plans.registry import query, with_views
from groundwork.sources.scratch import checkpointed
from groundwork.sources.tables import Tables


@query("graph_vertices", with_views(domain.VERTICES, select="SELECT id, label, name FROM vertices"))
def graph_vertices(t: Tables) -> DataFrame:
    return domain.vertices(t)


@query(
    "graph_dangling",
    with_views(
        domain.EDGES,
        domain.VERTICES,
        select="""SELECT src, dst, 'src' AS missing FROM edges WHERE src NOT IN (SELECT id FROM vertices)
UNION ALL SELECT src, dst, 'dst' FROM edges WHERE dst NOT IN (SELECT id FROM vertices)""",
    ),
)
def graph_dangling(t: Tables) -> DataFrame:
    """Suppliers in debt are no vertices, so their edges dangle."""
    return graph.dangling(domain.vertices(t), domain.edges(t))


@query(
    "graph_neighbors",
    with_views(
        domain.EDGES,
        domain.VERTICES,
        select="""SELECT src, dst, transit_days, cost, risk, label, name FROM edges JOIN vertices ON dst = id
WHERE src IN (SELECT id FROM vertices WHERE label = 'Port')""",
    ),
)
def graph_neighbors(t: Tables) -> DataFrame:
    vertex = domain.vertices(t)
    return graph.neighbors(domain.edges(t), vertex.where(F.col("label") == "Port").select("id"), vertex)


def _suppliers(t: Tables) -> DataFrame:
    return t["supplier"].select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("start"))


LINKS = """one AS (SELECT src AS start, dst AS id, transit_days, cost, risk FROM edges WHERE starts_with(src, 'S:')),
two AS (SELECT start, dst AS id, o.transit_days + e.transit_days AS transit_days,
               o.cost + e.cost AS cost, greatest(o.risk, e.risk) AS risk FROM one o JOIN edges e ON o.id = e.src),
three AS (SELECT start, dst AS id, o.transit_days + e.transit_days AS transit_days,
                 o.cost + e.cost AS cost, greatest(o.risk, e.risk) AS risk FROM two o JOIN edges e ON o.id = e.src)"""


@query(
    "graph_khop",
    with_views(
        domain.EDGES,
        LINKS,
        select="""SELECT 'S:' || s_suppkey AS start, 'S:' || s_suppkey AS id, 0 AS hops FROM supplier
UNION ALL SELECT DISTINCT start, id, 1 FROM one UNION ALL SELECT DISTINCT start, id, 2 FROM two
UNION ALL SELECT DISTINCT start, id, 3 FROM three""",
    ),
)
def graph_khop(t: Tables) -> DataFrame:
    """Everything within three hops of each supplier."""
    return graph.khop(domain.edges(t), _suppliers(t), 3)


@query(
    "path_totals",
    with_views(
        domain.EDGES,
        LINKS,
        select="""SELECT start, id, 1 AS hops, transit_days, cost, risk AS max_risk FROM one
UNION ALL SELECT start, id, 2, transit_days, cost, risk FROM two
UNION ALL SELECT start, id, 3, transit_days, cost, risk FROM three""",
    ),
)
def path_totals(t: Tables) -> DataFrame:
    return graph.path_totals(domain.edges(t), _suppliers(t), 3)


@query(
    "pattern_chain",
    with_views(
        domain.EDGES,
        domain.VERTICES,
        select="""SELECT s.id AS supplier, p.id AS plant, r.id AS port, x.cost AS feed_cost, y.cost AS export_cost
FROM vertices s JOIN edges x ON x.src = s.id JOIN vertices p ON x.dst = p.id JOIN edges y ON y.src = p.id JOIN vertices r ON y.dst = r.id
WHERE s.label = 'Supplier' AND p.label = 'Plant' AND r.label = 'Port' AND x.cost > 2000 AND r.name LIKE 'A%'""",
    ),
)
def pattern_chain(t: Tables) -> DataFrame:
    """Suppliers with costly feeds into plants that export through ports of some names."""
    found = patterns.match(
        domain.vertices(t),
        domain.edges(t),
        [Node("supplier", "Supplier"), Hop("feed", F.col("cost") > 2000), Node("plant", "Plant"), Hop("export"), Node("port", "Port", F.col("name").like("A%"))],
    )
    return found.select("supplier", "plant", "port", F.col("feed.cost").alias("feed_cost"), F.col("export.cost").alias("export_cost"))


@query(
    "pattern_reach",
    with_views(
        domain.EDGES,
        domain.VERTICES,
        """walks AS (
  SELECT DISTINCT src, dst, 1 AS hops FROM edges
  UNION SELECT DISTINCT a.src, b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src
  UNION SELECT DISTINCT a.src, c.dst, 3 FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src)""",
        select="""SELECT s.id AS supplier, w.id AS warehouse, hops FROM vertices s JOIN walks ON src = s.id JOIN vertices w ON dst = w.id
WHERE s.label = 'Supplier' AND w.label = 'Warehouse'""",
    ),
)
def pattern_reach(t: Tables) -> DataFrame:
    """Warehouses that a supplier reaches in one to three hops."""
    pattern = [Node("supplier", "Supplier"), Hop("hops", least=1, most=3), Node("warehouse", "Warehouse")]
    return patterns.match(domain.vertices(t), domain.edges(t), pattern)


@query(
    "pattern_risky_end",
    with_views(
        domain.EDGES,
        domain.VERTICES,
        select="""SELECT p.id AS plant, w.id AS warehouse, count(*) AS routes, round(max(z.transit_days), 6) AS slowest
FROM vertices p JOIN edges y ON y.src = p.id JOIN vertices r ON y.dst = r.id JOIN edges z ON z.src = r.id JOIN vertices w ON z.dst = w.id
WHERE p.label = 'Plant' AND r.label = 'Port' AND w.label = 'Warehouse' AND z.risk >= 0.05 AND p.name < w.name GROUP BY 1, 2""",
    ),
)
def pattern_risky_end(t: Tables) -> DataFrame:
    """Plants and the warehouses their goods reach over a risky last leg."""
    vertex = domain.vertices(t)
    pattern = [Node("plant", "Plant"), Hop("export"), Node("port", "Port"), Hop("ship", F.col("risk") >= 0.05), Node("warehouse", "Warehouse")]
    found = patterns.match(vertex, domain.edges(t), pattern)
    ends = found.where(F.substring("plant", 3, 1000) < F.substring("warehouse", 3, 1000)).groupBy("plant", "warehouse")
    return ends.agg(F.count("*").alias("routes"), F.round(F.max("ship.transit_days"), 6).alias("slowest"))


@query("sku_dependency", with_views(domain.SUPPLY, select="SELECT sku, tier, src, dst FROM dependency"))
def sku_dependency(t: Tables) -> DataFrame:
    return graph.sku_dependency(domain.supply(t))


@query(
    "bottlenecks",
    with_views(
        domain.SUPPLY,
        domain.LANES,
        domain.VERTICES,
        domain.DISRUPTIONS,
        select="""SELECT sku, v.id, label, location_name, disruption_type, severity, impact_score, delay_days
FROM (SELECT sku, src AS id FROM dependency UNION SELECT sku, dst FROM dependency) n
JOIN vertices v ON n.id = v.id JOIN disruptions ON name = location_name WHERE active_flag = 'Y'""",
    ),
)
def bottlenecks(t: Tables) -> DataFrame:
    return graph.bottlenecks(graph.sku_dependency(domain.supply(t)), domain.vertices(t), domain.disruptions(t))


# The tenth of the cells with the least stock is short, whatever the size of the tables.
SHORT_QUANTILE = 0.1


def _stock(t: Tables) -> tuple[DataFrame, int]:
    """The inventory, summed once into the checkpoint folder, and the threshold it implies."""
    stock = checkpointed(domain.inventory(t))
    low = quantiles.percentiles(stock, "on_hand", [SHORT_QUANTILE])[0]
    return stock, math.ceil(low or 0)


THRESHOLD = f"limits AS (SELECT CAST(ceil(quantile_cont(on_hand, {SHORT_QUANTILE})) AS BIGINT) AS threshold FROM inventory)"


@query(
    "stockout_risk",
    with_views(
        domain.INVENTORY,
        THRESHOLD,
        select="""SELECT sku, warehouse, on_hand, threshold AS min_threshold,
       CASE WHEN on_hand < threshold THEN 'CRITICAL_STOCKOUT' ELSE 'OK' END AS risk_status FROM inventory, limits""",
    ),
)
def stockout_risk(t: Tables) -> DataFrame:
    return inventory.stockout_risk(*_stock(t))


RELIEF = """short AS (SELECT sku, warehouse AS destination, threshold - on_hand AS deficit FROM inventory, limits WHERE on_hand < threshold),
surplus AS (
  SELECT sku, warehouse AS source, on_hand - threshold AS surplus FROM inventory, limits WHERE on_hand > threshold
  QUALIFY row_number() OVER (PARTITION BY sku ORDER BY on_hand DESC, warehouse) = 1),
relief AS (SELECT sku, destination, deficit, source, surplus FROM short JOIN surplus USING (sku))"""


@query(
    "relief_source",
    with_views(
        domain.INVENTORY, THRESHOLD, RELIEF, select="SELECT sku, destination, deficit, source, surplus FROM relief"
    ),
)
def relief_source(t: Tables) -> DataFrame:
    return inventory.relief_source(*_stock(t))


BEST = """best AS (
  SELECT origin, destination, transit_days, cost_per_ton, risk_factor, route_id, transport_mode FROM routes
  QUALIFY row_number() OVER (PARTITION BY origin, destination
                             ORDER BY transit_days, cost_per_ton, risk_factor, route_id) = 1)"""


@query("best_route", with_views(domain.ROUTES, BEST, select="SELECT * FROM best"))
def best_route(t: Tables) -> DataFrame:
    return inventory.best_route(domain.routes(t))


ALLOCATED = """needs AS (
  SELECT sku, warehouse AS destination, sum(threshold - on_hand) OVER w AS upto, threshold - on_hand AS part
  FROM inventory, limits WHERE on_hand < threshold
  WINDOW w AS (PARTITION BY sku ORDER BY on_hand, warehouse ROWS UNBOUNDED PRECEDING)),
gives AS (
  SELECT sku, warehouse AS source, sum(on_hand - threshold) OVER w AS upto, on_hand - threshold AS part
  FROM inventory, limits WHERE on_hand > threshold
  WINDOW w AS (PARTITION BY sku ORDER BY on_hand DESC, warehouse ROWS UNBOUNDED PRECEDING)),
allocated AS (
  SELECT n.sku, source, destination,
         CAST(least(n.upto, g.upto) - greatest(n.upto - n.part, g.upto - g.part) AS BIGINT) AS units
  FROM needs n JOIN gives g ON n.sku = g.sku AND n.upto - n.part < g.upto AND g.upto - g.part < n.upto)"""


@query(
    "transfer_drafts",
    with_views(
        domain.INVENTORY,
        THRESHOLD,
        ALLOCATED,
        domain.ROUTES,
        BEST,
        select=f"""SELECT '{inventory.DRAFT_PREFIX}' || lower(sku) || '-' || lower(r.source) || '-' || lower(r.destination) AS draft_action_id,
       '{inventory.TRANSFER}' AS action_type, sku, source, r.destination, units,
       route_id, transport_mode, transit_days, true AS requires_approval
FROM allocated r LEFT JOIN best b ON r.source = b.origin AND r.destination = b.destination""",
    ),
)
def transfer_drafts(t: Tables) -> DataFrame:
    stock, threshold = _stock(t)
    return inventory.transfer_drafts(stock, domain.routes(t), threshold)


@query(
    "shipment_risk",
    with_views(
        domain.SHIPMENTS,
        select=f"""SELECT product_id, status, count(*) AS n_shipments, CAST(sum(quantity) AS BIGINT) AS quantity,
       CAST(sum(risk) AS DOUBLE) / count(*) AS avg_risk,
       count(*) FILTER (WHERE risk >= {domain.AT_RISK}) AS n_at_risk
FROM shipments GROUP BY 1, 2""",
    ),
)
def shipment_risk(t: Tables) -> DataFrame:
    return inventory.shipment_risk(domain.shipments(t))


_COLOURS = ", ".join(f"'{c}'" for c in charts.PALETTE)
STOCK_CHART = f"""stock AS (SELECT warehouse AS label, CAST(sum(on_hand) AS BIGINT) AS value FROM inventory GROUP BY 1),
chart AS (
  SELECT CAST(row_number() OVER (ORDER BY value DESC, label) AS INTEGER) AS position, label, value FROM stock),
coloured AS (SELECT position, label, value, ([{_COLOURS}])[(position - 1) % 20 + 1] AS colour FROM chart)"""


def _stock_chart(t: Tables) -> DataFrame:
    total = F.sum("on_hand").cast("bigint")
    return charts.chart_dataset(domain.inventory(t), "warehouse", total)


@query(
    "chart_dataset",
    with_views(domain.INVENTORY, STOCK_CHART, select="SELECT position, label, value, colour FROM coloured"),
)
def chart_dataset(t: Tables) -> DataFrame:
    """Open stock by warehouse."""
    return _stock_chart(t)


@query(
    "chart_json",
    with_views(
        domain.INVENTORY,
        STOCK_CHART,
        select="""SELECT '{"type":"bar","data":{"labels":[' || string_agg('"' || label || '"', ',' ORDER BY position)
       || ']' || ',"datasets":[{"label":"Units","data":[' || string_agg(CAST(value AS VARCHAR), ',' ORDER BY position)
       || '],"backgroundColor":[' || string_agg('"' || colour || '"', ',' ORDER BY position)
       || '],"borderColor":[' || string_agg('"' || colour || '"', ',' ORDER BY position)
       || '],"borderWidth":1}]},"options":{"responsive":true,"plugins":{"title":{"display":true,"text":"Open stock by warehouse"}}}}'
       AS chart_json FROM coloured""",
    ),
)
def chart_json(t: Tables) -> DataFrame:
    return charts.chart_json(_stock_chart(t), "Open stock by warehouse", series="Units")


@query(
    "monthly_trend",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_rows,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM orders GROUP BY 1""",
)
def monthly_trend(t: Tables) -> DataFrame:
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return charts.monthly_trend(t["orders"], "o_orderdate", total)


@query(
    "chart_line",
    f"""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS label, count(*) AS value FROM orders GROUP BY 1),
p AS (SELECT CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS position, label, value FROM m)
SELECT position, label, value, ([{_COLOURS}])[(position - 1) % 20 + 1] AS colour FROM p""",
)
def chart_line(t: Tables) -> DataFrame:
    """Orders by month, in the order of the months."""
    by_month = t["orders"].select(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return charts.chart_dataset(by_month, "month", F.count("*"), kind="line")


@query(
    "chart_bubble",
    with_views(
        domain.INVENTORY,
        select="""SELECT warehouse AS label, count(*) AS x, CAST(sum(on_hand) AS BIGINT) AS y, CAST(max(on_hand) AS BIGINT) AS r
FROM inventory GROUP BY 1""",
    ),
)
def chart_bubble(t: Tables) -> DataFrame:
    """Warehouses by their SKUs and stock, the radius their largest cell."""
    stock = domain.inventory(t)
    largest = F.max("on_hand").cast("bigint")
    return charts.points_dataset(stock, "warehouse", F.count("*"), F.sum("on_hand").cast("bigint"), largest)


@query(
    "chart_limited",
    with_views(
        domain.INVENTORY,
        "stock AS (SELECT warehouse AS label, sum(on_hand) AS value FROM inventory GROUP BY 1)",
        "ranked AS (SELECT row_number() OVER (ORDER BY value DESC, label) AS place, label, value FROM stock)",
        "kept AS (SELECT least(place, 6) AS position, CASE WHEN place <= 5 THEN label ELSE '(others)' END AS label, value FROM ranked)",
        select=f"""SELECT CAST(position AS INTEGER) AS position, label, CAST(sum(value) AS BIGINT) AS value,
       ([{_COLOURS}])[(position - 1) % 20 + 1] AS colour FROM kept GROUP BY position, label""",
    ),
)
def chart_limited(t: Tables) -> DataFrame:
    """The five fullest warehouses, and all others as one."""
    total = F.sum("on_hand").cast("bigint")
    return charts.chart_dataset(domain.inventory(t), "warehouse", total, max_labels=5)
