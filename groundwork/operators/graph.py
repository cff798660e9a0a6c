"""Supply-chain graph: vertices (id, label, name) and edges (src, dst, transit_days, cost, risk).

Vertex ids carry their kind, so tables with overlapping keys can share one graph.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.sources.scratch import checkpointed


def vertices(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Union of (id, name) frames, one per label."""
    parts = [df.select("id", F.lit(label).alias("label"), "name") for label, df in tables.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def dangling(vertex: DataFrame, edge: DataFrame) -> DataFrame:
    """(src, dst, missing): edges whose ``src`` or ``dst`` is no vertex, one row per missing end."""
    ends = edge.select("src", "dst", F.explode(F.array(F.lit("src"), F.lit("dst"))).alias("missing")).withColumn(
        "id", F.when(F.col("missing") == "src", F.col("src")).otherwise(F.col("dst"))
    )
    return ends.join(vertex.select("id"), "id", "left_anti").select("src", "dst", "missing")


def neighbors(edge: DataFrame, ids: DataFrame | Sequence[str], vertex: DataFrame | None = None) -> DataFrame:
    """Outgoing edges of ``ids`` with their properties, and the neighbour's label and name."""
    if isinstance(ids, DataFrame):
        out = edge.join(ids.select(F.col(ids.columns[0]).alias("src")), "src", "left_semi")
    else:
        out = edge.where(F.col("src").isin(list(ids)))
    if vertex is not None:
        out = out.join(vertex.select(F.col("id").alias("dst"), "label", "name"), "dst")
    return out


def khop(edge: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """(start, id, hops): every vertex within ``k`` hops of each start, by its shortest hop count.

    Breadth-first over frames: a vertex is expanded once per start, so cycles end. The links
    and what each hop newly reaches are written to the shared checkpoint folder, once: that
    keeps the plan short and lets a lost executor cost one hop at most.
    """
    links = checkpointed(edge.select("src", "dst").distinct())
    start = starts.select(F.col(starts.columns[0]).alias("start")).distinct()
    frontier = checkpointed(start.select("start", F.col("start").alias("id"), F.lit(0).alias("hops")))
    reached = frontier
    for hop in range(1, k + 1):
        onward = frontier.join(links, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        unseen = onward.join(reached.select("start", "id"), ["start", "id"], "left_anti")
        frontier = checkpointed(unseen.withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def _unknown_last(figures: Sequence[str]) -> Column:
    """Order in which a missing figure comes after every known one."""
    return F.struct(*[F.coalesce(F.col(c), F.lit(float("inf"))).alias(f"o{i}") for i, c in enumerate(figures)])


def path_totals(edge: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """(start, id, hops, transit_days, cost, max_risk) of the quickest path of at most ``k`` hops.

    Quickest means least total transit, then cost, then worst edge risk, then hops; an unknown
    figure comes last. One
    best path per start and vertex is carried from hop to hop, never all paths.
    """
    figures = ("transit_days", "cost", "risk")
    links = checkpointed(
        edge.groupBy("src", "dst").agg(F.min_by(F.struct(*figures), _unknown_last(figures)).alias("e"))
    )
    best = starts.select(F.col(starts.columns[0]).alias("start")).distinct().select(
        "start",
        F.col("start").alias("id"),
        F.struct(
            F.lit(0.0).alias("transit_days"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("max_risk"), F.lit(0).alias("hops")
        ).alias("total"),
    )
    best = checkpointed(best)
    order = _unknown_last(("total.transit_days", "total.cost", "total.max_risk", "total.hops"))
    # Each round writes only the paths it finds or improves; the best of all rounds is taken at the end.
    found, frontier = best, best
    for hop in range(1, k + 1):
        onward = (
            frontier.join(links, F.col("id") == F.col("src"))
            .select(
                "start",
                F.col("dst").alias("id"),
                F.struct(
                    (F.col("total.transit_days") + F.col("e.transit_days")).alias("transit_days"),
                    (F.col("total.cost") + F.col("e.cost")).alias("cost"),
                    F.greatest("total.max_risk", "e.risk").alias("max_risk"),
                    F.lit(hop).alias("hops"),
                ).alias("total"),
            )
        )
        # What is known before counts as round 0 of this hop, so that a tie stays with it.
        both = onward.withColumn("new", F.lit(1)).unionByName(found.withColumn("new", F.lit(0)))
        least = F.min_by(F.struct("total", "new"), F.struct(order, "new")).alias("b")
        improved = both.groupBy("start", "id").agg(least).where("b.new = 1").select("start", "id", F.col("b.total").alias("total"))
        frontier = checkpointed(improved)
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    best = found.groupBy("start", "id").agg(F.min_by("total", order).alias("total"))
    return best.where(F.col("id") != F.col("start")).select(
        "start", "id", "total.hops", "total.transit_days", "total.cost", "total.max_risk"
    )


def sku_dependency(supply: DataFrame, sku: str | None = None) -> DataFrame:
    """(sku, tier, src, dst): the supplier -> plant -> port -> warehouse links of each SKU.

    ``supply`` has (sku, supplier, plant, port, warehouse). An unknown SKU gives no rows.
    """
    if sku is not None:
        supply = supply.where(F.col("sku") == sku)
    chain = F.array(
        F.struct(F.lit(1).alias("tier"), F.col("supplier").alias("src"), F.col("plant").alias("dst")),
        F.struct(F.lit(2).alias("tier"), F.col("plant").alias("src"), F.col("port").alias("dst")),
        F.struct(F.lit(3).alias("tier"), F.col("port").alias("src"), F.col("warehouse").alias("dst")),
    )
    return supply.select("sku", F.explode(chain).alias("link")).select("sku", "link.*").distinct()


def bottlenecks(dependency: DataFrame, vertex: DataFrame, disruptions: DataFrame) -> DataFrame:
    """Active disruptions on each SKU's path, matched by the vertex's location name.

    A vertex touched by several links of a SKU counts once; a disruption at a location that
    is no vertex matches nothing.
    """
    touched = dependency.select("sku", F.explode(F.array("src", "dst")).alias("id")).distinct()
    active = disruptions.where(F.col("active_flag") == "Y")
    return (
        touched.join(vertex.select("id", "label", F.col("name").alias("location_name")), "id")
        .join(active, "location_name")
        .select("sku", "id", "label", "location_name", "disruption_type", "severity", "impact_score", "delay_days")
    )
