"""Quantiles without sorting a table and without a map of its values: mergeable sketches, and exact refinement.

A sketch brackets the wanted place between two values; one count says how many rows lie below, on and between
them. Rows on a bracket's ends are settled by the counts, whatever their number, so a value that a third of all
rows hold costs nothing extra; what lies strictly between is bracketed again, about a fiftieth of the rows each
time, until so few rows are left that they are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch, the share of ranks by which a bracket exceeds the place looked for, and rows that may be gathered.
SKETCH, MARGIN, GATHERED = 800, 0.01, 100_000


def percentiles(df: DataFrame, column: str, shares: Sequence[float], gathered: int = GATHERED) -> list[float | None]:
    """Exact quantiles, interpolated between neighbouring values; None for each when there is no value.

    NULL and NaN are left out. Two passes over the column for up to ``gathered`` rows in a bracket, two more for
    every fiftyfold; the driver holds at most ``gathered`` numbers at a time.
    """
    if not all(0 <= share <= 1 for share in shares):
        raise ValueError("shares must be between 0 and 1")
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = values.count()
    if n == 0:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    found = order_statistics(values, n, {int(p) for p in places} | {math.ceil(p) for p in places}, gathered)
    ends = [(found[int(p)], found[math.ceil(p)], p - int(p)) for p in places]
    return [low if low == high else low + (high - low) * part for low, high, part in ends]


def order_statistics(values: DataFrame, n: int, ranks: set[int], gathered: int = GATHERED) -> dict[int, float]:
    """rank -> value, from 0, of the ``n`` rows of one double column ``v`` without NULL and NaN."""
    done: dict[int, float] = {}
    # rank -> (low, high, rows up to low, rows strictly between); None is no end.
    todo: dict[int, tuple] = {rank: (None, None, 0, n) for rank in ranks}
    while todo:
        for low, high in {x[:2] for x in todo.values() if x[3] <= gathered}:
            held = sorted(r["v"] for r in values.where(_inside(low, high)).collect())
            for rank in [k for k, x in todo.items() if x[:2] == (low, high)]:
                done[rank] = held[rank - todo.pop(rank)[2]]
        if not todo:
            break
        ranges = list({x[:2]: None for x in todo.values()})
        sketched = values.agg(
            *(F.kll_sketch_agg_double(F.when(_inside(*r), F.col("v")), F.lit(SKETCH)).alias(f"s{i}") for i, r in enumerate(ranges))
        )
        ends = []
        for rank, (low, high, below, inside) in todo.items():
            share, sketch = (rank - below) / max(inside - 1, 1), f"s{ranges.index((low, high))}"
            for end in (max(0.0, share - MARGIN), min(1.0, share + MARGIN)):
                ends.append(F.kll_sketch_get_quantile_double(sketch, F.lit(float(end))))
        row = sketched.select(*(e.alias(f"e{i}") for i, e in enumerate(ends))).first()
        brackets = {rank: (row[2 * i], row[2 * i + 1]) for i, rank in enumerate(todo)}
        counts = values.agg(*(c for rank, ab in brackets.items() for c in _counts(rank, *todo[rank][:2], *ab))).first()
        for rank, (a, b) in brackets.items():
            low, high, below, _ = todo[rank]
            under, on_a, between, on_b, over = (counts[f"{name}_{rank}"] for name in ("under", "a", "between", "b", "over"))
            for size, value, where in (
                (under, None, (low, a)),
                (on_a, a, None),
                (between, None, (a, b)),
                (on_b, b, None),
                (over, None, (b, high)),
            ):
                if rank < below + size:
                    if where is None:
                        done[rank] = value
                        del todo[rank]
                    else:
                        todo[rank] = (*where, below, size)
                    break
                below += size
    return done


def _inside(low: float | None, high: float | None) -> Column:
    above = F.lit(True) if low is None else F.col("v") > low
    return above if high is None else above & (F.col("v") < high)


def _counts(rank: int, low: float | None, high: float | None, a: float, b: float) -> list[Column]:
    v, held = F.col("v"), _inside(low, high)
    parts = {"under": v < a, "a": v == a, "between": (v > a) & (v < b), "b": (v == b) & F.lit(a != b), "over": v > b}
    return [F.count_if(held & test).alias(f"{name}_{rank}") for name, test in parts.items()]


def sketches(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, n, sketch): one mergeable sketch per group, about 10 kB however many rows it saw."""
    return df.groupBy(*keys).agg(
        F.count(column).alias("n"), F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(SKETCH)).alias("sketch")
    )


def sketched_quantiles(stored: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(keys, share, value) of sketches merged by ``keys``: about the quantiles, within a percent of the ranks."""
    merged = stored.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    pairs = F.array(*(F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("value")) for s in shares))
    return merged.select(*keys, F.inline(pairs))
