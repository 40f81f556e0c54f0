"""Windows over several streams against plain slices."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import streams as M
from panelspark.operators import windows as X
from panelspark.operators.segments import ROW
from panelspark.schema import Series

CTX, PRED, N = 6, 3, 50


def tables(spark, n=N):
    rng = np.random.default_rng(0)
    day = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(n)]
    x = {i: rng.normal(size=n) for i in "ab"}
    target = spark.createDataFrame([(i, day[k], float(x[i][k]), float(x[i][k]) + 50) for i in "ab" for k in range(n)],
                                   "id string, t date, x double, raw double")
    cov = spark.createDataFrame([(i, day[k], float(k), float(ord(i))) for i in "ab" for k in range(n)], "id string, t date, c double, d double")
    shared = spark.createDataFrame([(day[k], float(-k)) for k in range(n)], "t date, g double")
    known = spark.createDataFrame([(day[k], float(k % 7)) for k in range(n)], "t date, dow double")
    news = spark.createDataFrame([(day[k], [float(k), 1.0]) for k in range(0, n, 4)], "t date, embedding array<double>")
    return x, target, cov, shared, known, news


def looking():
    ctx, ahead = CTX, PRED

    def look(w, pred, mc, seed):
        """Fails in the task unless every stream is the slice it should be."""
        first = int(w.covariates[0, 0])
        assert w.covariates[:, 0].tolist() == [float(first + k) for k in range(ctx)]
        assert len(set(w.covariates[:, 1])) == 1 and (w.covariates[:, 2] == -w.covariates[:, 0]).all()
        assert w.known[:, 0].tolist() == [float((first + ctx + k) % 7) for k in range(ahead)]
        assert w.news.tolist() == [[float(k), 1.0] if k % 4 == 0 else [0.0, 0.0] for k in range(first, first + ctx)]
        return np.tile(w.tokens[-1] + np.arange(pred), (mc, 1)) + np.arange(mc)[:, None]
    return look


@pytest.mark.parametrize("size", [4, 512])
@pytest.mark.parametrize("mode", ["no_diff", "diff", "log_diff"])
def test_windows_hold_the_slices_of_every_stream(spark, size, mode):
    x, target, cov, shared, known, news = tables(spark)
    s = Series()
    panel = M.join_streams(target, s, cov, shared, known, news, dim=2)
    got = M.forecast_streams(panel, s, looking(), CTX, PRED, 3, mode=mode, keep_tokens=True, size=size).collect()
    assert len(got) == 2 * (N - CTX - PRED + 1) * PRED
    for r in got:
        i = r.window - 1 + CTX
        past = x[r.id][i - CTX:i]
        assert r.scale == pytest.approx(np.abs(past).mean())
        assert r.naive == past[-1] + 50 and r.truth == x[r.id][i + r.horizon - 1] + 50
        assert r.t == dt.date(2024, 1, 1) + dt.timedelta(days=i + r.horizon - 1)
        tokens = M.token_array(past[-1:], r.scale)[0] + np.arange(r.horizon) + np.arange(3)[:, None]
        assert sorted(r.tokens) == tokens[:, -1].tolist()
        d = M.detoken_array(tokens, r.scale)
        level = {"no_diff": d, "diff": r.naive + d.cumsum(axis=1), "log_diff": r.naive * np.exp(d.cumsum(axis=1))}[mode]
        assert np.allclose(r.ens, np.sort(level[:, -1]))


def test_tokens_of_arrays_are_those_of_columns(spark):
    v = np.random.default_rng(1).uniform(-40, 40, 500)
    df = spark.createDataFrame([(float(a),) for a in v], "v double").select("v", X.token(F.col("v"), F.lit(1.7)).alias("k"))
    df = df.withColumn("back", X.detoken(F.col("k"), F.lit(1.7))).toPandas()
    assert (M.token_array(df.v.to_numpy(), 1.7) == df.k).all()
    assert np.allclose(M.detoken_array(df.k.to_numpy(), 1.7), df.back, rtol=0, atol=1e-12)


def test_streams_that_do_not_align_raise(spark):
    _, target, cov, _, known, _ = tables(spark)
    with pytest.raises(ValueError, match="not aligned"):
        M.join_streams(target, Series(), cov.where("c <> 7"))
    with pytest.raises(ValueError, match="not aligned"):
        M.join_streams(target, Series(), cov, known=known.where("dow < 6"))


def test_absent_streams_and_short_series(spark):
    _, target, *_ = tables(spark, CTX + PRED)
    panel = M.join_streams(target, Series())

    ctx, ahead = CTX, PRED

    def fn(w, pred, mc, seed):
        assert w.covariates.shape == (ctx, 0) and w.known.shape == (ahead, 0) and w.news.shape == (ctx, 0)
        return np.full((mc, pred), w.tokens[-1])
    assert M.forecast_streams(panel, Series(), fn, CTX, PRED, 2).count() == 2 * PRED
    assert M.forecast_streams(panel.where("t < '2024-01-09'"), Series(), fn, CTX, PRED, 2).count() == 0
    given = panel.withColumns({ROW: F.dayofyear("t"), "k": F.lit(4.0)})
    assert {r.scale for r in M.forecast_streams(given, Series(), fn, CTX, PRED, 2, scale="k").collect()} == {4.0}
