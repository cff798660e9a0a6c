"""Chart-ready aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.operators.joins import numbered

# The chart types and the colours, in the order they are dealt.
CHART_TYPES = ("bar", "line", "pie", "doughnut", "radar", "scatter", "bubble", "polarArea")
POINTS = ("scatter", "bubble")
PALETTE = (
    "#007bff", "#6c757d", "#28a745", "#ffc107", "#dc3545",
    "#20c997", "#6610f2", "#e83e8c", "#fd7e14", "#17a2b8",
    "#8bc34a", "#673ab7", "#03a9f4", "#ff9800", "#ff5722",
    "#4caf50", "#795548", "#607d8b", "#c2185b", "#343a40",
)


# What the row of all labels beyond a limit is called.
OTHERS = "(others)"


#: Labels that one chart may show.
DRAWN = 10_000


def chart_dataset(
    df: DataFrame, label: str, value: Column, kind: str = "bar", max_labels: int | None = None
) -> DataFrame:
    """(position, label, value, colour) of every label, colours dealt in turn.

    ``value`` is an aggregate. A line runs along its labels; other charts show the largest value
    first. With ``max_labels``, the labels beyond it are aggregated into one last row. Points are
    made by :func:`points_dataset`.
    """
    if kind not in CHART_TYPES:
        raise ValueError(f"chart type must be one of {CHART_TYPES}")
    if kind in POINTS:
        raise ValueError(f"{kind} charts take points_dataset")
    order = [F.asc("label")] if kind == "line" else [F.desc("value"), F.asc("label")]
    totals = df.groupBy(F.col(label).alias("label")).agg(value.alias("value"))
    if max_labels is None:
        return _coloured(numbered(totals, *order))
    top = totals.orderBy(*order).limit(max_labels).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    shown = top.select(F.col("label").alias("__shown")).withColumn("__is", F.lit(True))
    beyond = df.join(F.broadcast(shown), F.col(label).eqNullSafe(F.col("__shown")), "left").where("__is IS NULL")
    rest = beyond.agg(value.alias("value"), F.count("*").alias("n")).where("n > 0").select(
        F.lit(OTHERS).alias("label"), "value", F.lit(max_labels + 1).alias("position")
    )
    return _coloured(top.unionByName(rest))


def _coloured(placed: DataFrame) -> DataFrame:
    colours = F.array(*[F.lit(c) for c in PALETTE])
    return placed.select(
        "position", "label", "value", F.element_at(colours, (F.col("position") - 1) % len(PALETTE) + 1).alias("colour")
    )


def points_dataset(df: DataFrame, label: str, x: Column, y: Column, r: Column | None = None) -> DataFrame:
    """(label, x, y) for scatter charts, with the radius ``r`` for bubbles: aggregates per label."""
    measures = {"x": x, "y": y} | ({} if r is None else {"r": r})
    return df.groupBy(F.col(label).alias("label")).agg(*[m.alias(n) for n, m in measures.items()])


def chart_json(dataset: DataFrame, title: str, kind: str = "bar", series: str = "value", most: int = DRAWN) -> DataFrame:
    """One row (chart_json) describing the whole chart; for the output of :func:`chart_dataset`.

    More than ``most`` labels are no chart: the query fails before it has gathered them all, and
    ``max_labels`` of :func:`chart_dataset` is the way to sum up the rest.
    """
    if kind not in CHART_TYPES:
        raise ValueError(f"chart type must be one of {CHART_TYPES}")
    some = dataset.limit(most + 1)
    rows = some.agg(F.array_sort(F.collect_list(F.struct("position", "label", "value", "colour"))).alias("r"))
    too_many = F.raise_error(F.lit(f"the dataset has more than {most} labels; give chart_dataset max_labels"))
    rows = rows.select(F.when(F.size("r") <= most, F.col("r")).otherwise(too_many).alias("r"))
    chart = F.struct(
        F.lit(kind).alias("type"),
        F.struct(
            F.col("r.label").alias("labels"),
            F.array(
                F.struct(
                    F.lit(series).alias("label"),
                    F.col("r.value").alias("data"),
                    F.col("r.colour").alias("backgroundColor"),
                    F.col("r.colour").alias("borderColor"),
                    F.lit(1).alias("borderWidth"),
                )
            ).alias("datasets"),
        ).alias("data"),
        F.struct(
            F.lit(True).alias("responsive"),
            F.struct(F.struct(F.lit(True).alias("display"), F.lit(title).alias("text")).alias("title")).alias("plugins"),
        ).alias("options"),
    )
    return rows.select(F.to_json(chart).alias("chart_json"))


def monthly_trend(df: DataFrame, ts: str, value: Column) -> DataFrame:
    """(month, n_rows, value) per calendar month; ``value`` is an aggregate."""
    return df.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_rows"), value.alias("value")
    )
