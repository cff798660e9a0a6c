import math

import numpy as np
import pytest

from groundwork.operators import quantiles


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(4)


@pytest.mark.parametrize("gathered", [1, 50, 100_000])
@pytest.mark.parametrize("kind", ["spread", "hot", "two", "same", "infinite", "one"])
def test_percentiles_are_exact(spark, kind, gathered):
    pick = np.random.default_rng(4)
    values = {
        "spread": pick.lognormal(0, 4, 4000),
        "hot": np.concatenate([np.full(1500, 3.25), pick.normal(3, 2, 2500)]),
        "two": np.concatenate([np.zeros(700), np.ones(701)]),
        "same": np.full(500, -2.0),
        "infinite": np.concatenate([[-math.inf] * 30, pick.normal(0, 1, 400), [math.inf] * 30]),
        "one": np.array([7.0]),
    }[kind].tolist()
    shares = [0, 0.001, 0.25, 0.5, 0.9, 1]
    if kind == "infinite":
        shares = [0, 0.25, 0.5, 1]
    got = quantiles.percentiles(column(spark, [*values, None, math.nan]), "x", shares, gathered)
    assert got == pytest.approx([float(np.quantile(values, s)) if kind != "infinite" else sorted(values)[round(s * (len(values) - 1))] for s in shares], abs=0.01 if kind == "infinite" else 1e-9)


def test_nothing_and_bad_shares(spark):
    assert quantiles.percentiles(column(spark, [None, math.nan]), "x", [0.5, 1]) == [None, None]
    with pytest.raises(ValueError):
        quantiles.percentiles(column(spark, [1.0]), "x", [1.5])


def test_sketches_of_parts_merge(spark):
    values = np.random.default_rng(5).normal(size=20_000)
    df = spark.createDataFrame([(i % 7, "ab"[i % 2], float(v)) for i, v in enumerate(values)], "part int, kind string, x double")
    stored = quantiles.sketches(df, ["part", "kind"], "x")
    assert stored.count() == 14
    for row in quantiles.sketched_quantiles(stored, ["kind"], [0.1, 0.5, 0.9]).collect():
        mine = values[(0 if row.kind == "a" else 1) :: 2]
        assert abs((mine <= row.value).mean() - row.share) < 0.01
