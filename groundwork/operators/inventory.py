"""Stock positions, relief sources, routes and transfer drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRITICAL = "CRITICAL_STOCKOUT"
OK = "OK"
# The example threshold, the transfer's type and its id prefix.
MIN_THRESHOLD = 300
TRANSFER = "INVENTORY_TRANSFER"
DRAFT_PREFIX = "draft-transfer-"


def stockout_risk(inventory: DataFrame, min_threshold: int = MIN_THRESHOLD) -> DataFrame:
    """(sku, warehouse, on_hand, min_threshold, risk_status): CRITICAL_STOCKOUT below the threshold."""
    held = inventory.groupBy("sku", "warehouse").agg(F.sum("on_hand").cast("bigint").alias("on_hand"))
    return held.withColumns(
        {
            "min_threshold": F.lit(min_threshold).cast("bigint"),
            "risk_status": F.when(F.col("on_hand") < min_threshold, F.lit(CRITICAL)).otherwise(F.lit(OK)),
        }
    )


def relief_source(inventory: DataFrame, min_threshold: int = MIN_THRESHOLD) -> DataFrame:
    """Per short (sku, destination): the warehouse with the largest surplus of that SKU.

    The best source does not depend on the destination, so it is found once per SKU and
    joined on; short and surplus cells are never paired. Ties go to the smaller name. A short
    cell whose SKU has no surplus anywhere has no row.
    """
    held = stockout_risk(inventory, min_threshold)
    short = held.where(F.col("on_hand") < min_threshold).select(
        "sku", F.col("warehouse").alias("destination"), (F.lit(min_threshold) - F.col("on_hand")).alias("deficit")
    )
    best = (
        held.where(F.col("on_hand") > min_threshold)
        .groupBy("sku")
        .agg(F.min(F.struct((min_threshold - F.col("on_hand")).alias("order"), "warehouse")).alias("best"))
        .select("sku", F.col("best.warehouse").alias("source"), (-F.col("best.order")).alias("surplus"))
    )
    return short.join(best, "sku")


def best_route(routes: DataFrame) -> DataFrame:
    """One route per (origin, destination): least transit, then cost, then risk, then id.

    A missing figure ranks last.
    """
    figures = ("transit_days", "cost_per_ton", "risk_factor")
    order = F.struct(*[F.coalesce(F.col(c), F.lit(float("inf"))).alias(c) for c in figures], "route_id")
    best = F.min_by(F.struct(*figures, "route_id", "transport_mode"), order).alias("r")
    return routes.groupBy("origin", "destination").agg(best).select("origin", "destination", "r.*")


def allocate(inventory: DataFrame, min_threshold: int = MIN_THRESHOLD) -> DataFrame:
    """(sku, source, destination, units): deficits covered from surpluses, no unit promised twice.

    The deficits of a SKU, largest first, and its surpluses, largest first, are laid end to end
    along one line each; where both lines overlap, that many units go from the one to the other.
    Running sums per SKU place the ends; every stretch between two neighbouring ends is one
    transfer, so short and surplus cells are never paired. What exceeds the surplus stays short.
    """
    held = stockout_risk(inventory, min_threshold)
    gap = F.lit(min_threshold) - F.col("on_hand")
    cells = held.where(gap != 0).select(
        "sku", (gap > 0).alias("short"), "warehouse", F.abs(gap).cast("bigint").alias("size")
    )
    line = Window.partitionBy("sku", "short").orderBy(F.desc("size"), "warehouse")
    placed = cells.withColumn("start", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    whole = F.sum("size").over(Window.partitionBy("sku", "short"))
    placed = placed.withColumn("whole", whole)
    along = Window.partitionBy("sku").orderBy("start", "short")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    sku = Window.partitionBy("sku")

    def latest(short: bool, column: str) -> Column:
        return F.last(F.when(F.col("short") == short, F.col(column)), ignorenulls=True).over(so_far)

    def total(short: bool) -> Column:
        return F.coalesce(F.max(F.when(F.col("short") == short, F.col("whole"))).over(sku), F.lit(0))

    end = F.least(F.coalesce(F.lead("start").over(along), F.greatest(total(True), total(False))), total(True), total(False))
    return placed.select(
        "sku", latest(False, "warehouse").alias("source"), latest(True, "warehouse").alias("destination"), (end - F.col("start")).alias("units")
    ).where(F.col("units") > 0)


def transfer_drafts(inventory: DataFrame, routes: DataFrame, min_threshold: int = MIN_THRESHOLD) -> DataFrame:
    """A draft for every transfer of :func:`allocate`; a person approves each.

    Source and destination are part of the id, since one SKU can be short in several places and
    one place can need several sources.
    """
    relief = allocate(inventory, min_threshold)
    by_route = best_route(routes).select(
        F.col("origin").alias("source"), "destination", "route_id", "transport_mode", "transit_days"
    )
    return relief.join(by_route, ["source", "destination"], "left").select(
        F.concat(F.lit(DRAFT_PREFIX), F.lower("sku"), F.lit("-"), F.lower("source"), F.lit("-"), F.lower("destination")).alias("draft_action_id"),
        F.lit(TRANSFER).alias("action_type"),
        "sku",
        "source",
        "destination",
        "units",
        "route_id",
        "transport_mode",
        "transit_days",
        F.lit(True).alias("requires_approval"),
    )


def shipment_risk(shipments: DataFrame) -> DataFrame:
    """(product_id, status, n_shipments, quantity, avg_risk, n_at_risk) over shipment rows.

    ``shipments`` may already be partly summed: its rows carry n_shipments, quantity,
    risk_total and n_at_risk.
    """
    return (
        shipments.groupBy("product_id", "status")
        .agg(
            F.sum("n_shipments").cast("bigint").alias("n_shipments"),
            F.sum("quantity").cast("bigint").alias("quantity"),
            F.sum("risk_total").alias("risk_total"),
            F.sum("n_at_risk").cast("bigint").alias("n_at_risk"),
        )
        .select(
            "product_id",
            "status",
            "n_shipments",
            "quantity",
            (F.col("risk_total").cast("double") / F.col("n_shipments")).alias("avg_risk"),
            "n_at_risk",
        )
    )
