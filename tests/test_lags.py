"""Lagged products in overlapping segments against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import evaluate as E
from panelspark.operators import indicators as I
from panelspark.operators import segments as G
from panelspark.schema import Series

S = Series(("id",), "t")


def frame(spark, series):
    rows = [(k, i, None if v is None else float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "id string, t int, x double")


def test_products_cross_segments(spark):
    rng = np.random.default_rng(1)
    series = {"a": rng.normal(size=53), "b": rng.normal(size=8), "one": [2.0], "exact": rng.normal(size=16)}
    df = G.number_rows(frame(spark, series), S)
    lags = [0, 1, 3, 8, 20, 60]
    for size in (4, 8, 64):
        got = {(r["id"], r["lag"]): r["total"] for r in G.lagged_products(df, S, "x", lags, [], size=size).collect()}
        assert len(got) == len(series) * len(lags)
        for (k, lag), v in got.items():
            x = np.asarray(series[k])
            assert v == pytest.approx(float(x[lag:] @ x[:len(x) - lag]) if lag < len(x) else 0.0, abs=1e-9), (k, lag, size)
    with pytest.raises(ValueError):
        G.lagged_products(df, S, "x", [], [])


def test_autocorrelation_far_from_zero(spark):
    """Centred before it is multiplied: an offset of 1e9 changes nothing that matters."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=400).cumsum()
    series = {"far": x + 1e9, "flat": [0.1] * 30, "short": [1.0, 3.0], "holes": [None, 1.0, None, 2.0, 4.0, None]}
    got = {(r["id"], r["lag"]): r["acf"] for r in I.acf(frame(spark, series), S, "x", [1, 5, 100]).collect()}
    c = (series["far"] - series["far"].mean())
    for lag in (1, 5, 100):
        assert got["far", lag] == pytest.approx(float(c[lag:] @ c[:-lag] / (c @ c)), abs=1e-6)
    assert got["flat", 1] is None and got["flat", 5] is None and ("flat", 100) not in got
    assert [k for k in got if k[0] == "short"] == [("short", 1)] and got["short", 1] == pytest.approx(-.5)
    h = np.array([1.0, 2.0, 4.0]) - 7 / 3
    assert got["holes", 1] == pytest.approx(float(h[1:] @ h[:-1] / (h @ h)))


def loss_frame(spark, d):
    return spark.createDataFrame([(i, None if v is None else float(v), 0.0) for i, v in enumerate(d)],
                                 "window int, mse double, mse_naive double")


@pytest.mark.parametrize("h", [1, 4, 9])
def test_dm_equals_plain_sums(spark, h):
    d = np.random.default_rng(3).normal(size=70) + .3
    c = d - d.mean()
    var = sum((1 if k == 0 else 2 * (1 - k / h)) * float(c[k:] @ c[:len(c) - k]) / len(c) for k in range(h))
    got = E.dm_test(loss_frame(spark, d), [], h=h).first()
    assert got["n"] == 70 and got["stat"] == pytest.approx(d.mean() / np.sqrt(var / 70 + 1e-12))


def test_dm_of_nothing(spark):
    got = E.dm_test(loss_frame(spark, []), [], h=3).first()
    assert got["n"] == 0 and got["stat"] is None
    got = E.dm_test(loss_frame(spark, [None, None]), [], h=3).first()
    assert got["n"] == 2 and got["stat"] is None


def test_exchanges_do_not_grow_with_lags(spark):
    df = frame(spark, {"a": range(9)})
    plans = [I.acf(df, S, "x", lags)._jdf.queryExecution().executedPlan().toString() for lags in ([1], [1, 2, 3, 4, 5, 6])]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")
    assert "Join" not in plans[0].split("Exchange hashpartitioning(id#")[0]
