"""Segmented and bucketed results equal the plain single-window ones, whatever the cut."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import indicators as I
from panelspark.operators import segments as G
from panelspark.operators import stats as S
from panelspark.operators import windows as X
from panelspark.operators.calendar import ffill_bfill, interpolate_time
from panelspark.schema import Series

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def hot(spark, n=600, seed=1, holes=0.0):
    """One series holds most rows; uneven time steps; optional holes."""
    rng = np.random.default_rng(seed)
    rows = []
    for i, m in (("hot", n), ("b", n // 8), ("c", 3)):
        days = np.sort(rng.choice(np.arange(4 * n), m, replace=False))
        for d in days:
            x = None if rng.random() < holes else float(rng.lognormal())
            rows.append((i, dt.date(2000, 1, 1) + dt.timedelta(days=int(d)), x))
    return spark.createDataFrame(rows, "id string, t date, x double")


@pytest.mark.parametrize("bucket", ["year", "month"])
def test_row_numbers(spark, bucket):
    s = Series(("id",), "t", bucket)
    out = G.number_rows(hot(spark), s, "n", "len_")
    w = Window.partitionBy("id")
    out = out.withColumns({"want": F.row_number().over(w.orderBy("t")), "wl": F.count("*").over(w)})
    assert out.filter("n <> want or len_ <> wl").count() == 0 and out.count() == 678


@pytest.fixture(params=[None, 3])
def fan(request, monkeypatch):
    """Runs of the library's length, and runs so short that the trees have all their levels."""
    if request.param:
        monkeypatch.setattr(G, "FAN", request.param)
        monkeypatch.setattr(G, "FAN_MAPS", request.param)


@pytest.mark.parametrize("size", [7, 64, 2048])
def test_ema_matches_pandas_for_any_segment_size(spark, size, fan):
    s = Series(("id",), "t", "year")
    df = hot(spark)
    spans = {"e1": 1, "e2": 2, "e12": 12, "e26": 26, "e_near_1": 1.001}
    got = I.add_emas(df, s, "x", spans, size).orderBy("id", "t").toPandas()
    for name, span in spans.items():
        want = got.groupby("id")["x"].transform(lambda v: v.ewm(span=span, adjust=False).mean())
        assert np.allclose(got[name], want, rtol=1e-12, atol=0)


@pytest.mark.parametrize("first", [1e12, 1e200])
def test_every_row_counts_in_an_ema(spark, first):
    """A first value far above the rest still counts hundreds of rows later, in segments far from its own."""
    rows = [("a", k, first if k == 0 else 1.0 + k % 3) for k in range(700)]
    df = spark.createDataFrame(rows, "id string, t long, x double")
    got = I.add_emas(df, Series(), "x", {"e5": 5, "e26": 26, "e400": 400}, 32).orderBy("t").toPandas()
    for span in (5, 26, 400):
        want = got["x"].ewm(span=span, adjust=False).mean()
        assert np.allclose(got[f"e{span}"], want, rtol=1e-11, atol=0)


@pytest.mark.parametrize("size", [5, 2048])
def test_ema_with_holes_of_any_length(spark, size, fan):
    rng = np.random.default_rng(4)
    x = [float(rng.lognormal()) if k % 97 < 60 and rng.random() < 0.6 and not 300 < k < 900 else None for k in range(1200)]
    x[1] = 1e12
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(x)], "id string, t long, x double")
    got = I.add_emas(df, Series(("id",), "t", "100"), "x", {"e3": 3, "e30": 30}, size).orderBy("t").toPandas()
    for span in (3, 30):
        want = got["x"].ewm(span=span, adjust=False).mean()
        assert np.allclose(got[f"e{span}"].astype(float), want, rtol=1e-11, atol=0, equal_nan=True)


@pytest.mark.parametrize("unit", ["second", "hour", "day", "week", "month", "quarter", "year"])
def test_state_crosses_runs_of_buckets(spark, unit, fan):
    """Sums, fills and first values through a tree of buckets equal those of one window."""
    rng = np.random.default_rng(len(unit))
    rows = []
    for i, n in (("hot", 300), ("b", 20), ("one", 1)):
        step = {"second": 1, "hour": 1800, "day": 40_000}.get(unit, 2_000_000)
        at = dt.datetime(1969, 6, 1) + dt.timedelta(hours=int(rng.integers(20)))
        for _ in range(n):
            at += dt.timedelta(seconds=int(rng.integers(1, step * 3)))
            rows.append((i, at, None if rng.random() < 0.7 else float(rng.integers(100)), float(rng.integers(9) - 4)))
    df = spark.createDataFrame(rows, "id string, t timestamp_ntz, x double, y double")
    s = Series(("id",), "t", unit)
    got = G.running(df.withColumn("f", F.col("x")), s, G.row_numbers(s, "n", "len_"), G.fills(s, ["f"]), G.sums(s, "y", "total"),
                    I.first_valid(s, "x", "first_x"), I.all_positive(s, "y", "pos")).orderBy("id", "t").toPandas()
    assert len(got) == 321
    for _, p in got.groupby("id"):
        assert (p["n"] == np.arange(1, len(p) + 1)).all() and (p["len_"] == len(p)).all()
        assert np.allclose(p["f"].astype(float), p["x"].astype(float).ffill().bfill(), equal_nan=True)
        assert np.allclose(p["total"], p["y"].cumsum())
        known = p["x"].dropna()
        assert (p["first_x"] == known.iloc[0]).all() if len(known) else p["first_x"].isna().all()
        assert (p["pos"] == (p["y"].min() > 0)).all()


@pytest.mark.parametrize("size", [5, 2048])
def test_rolling_matches_pandas(spark, size):
    s = Series(("id",), "t")
    out = G.rolled(hot(spark), s, lambda w: {
        "sd": G.when_full(F.stddev_samp("x"), F.col("x"), w, 14), "lag10": F.lag("x", 10).over(w)}, back=14, size=size)
    got = out.orderBy("id", "t").toPandas()
    g = got.groupby("id")["x"]
    assert np.allclose(got["sd"], g.transform(lambda v: v.rolling(14).std()), equal_nan=True)
    assert np.allclose(got["lag10"], g.shift(10), equal_nan=True)


def test_no_segment_grows_with_the_series(spark):
    s = Series(("id",), "t")
    seg = G.segmented(hot(spark, 1000), s, back=20, ahead=5, size=50)
    assert seg.groupBy("id", G.SEG).count().agg(F.max("count")).first()[0] <= 75
    assert G.own_rows(seg).count() == 1000 + 125 + 3


@FEW
@given(seed=st.integers(0, 10**6), holes=st.floats(0.1, 0.9))
def test_fills_cross_buckets(spark, seed, holes):
    s = Series(("id",), "t", "month")
    df = hot(spark, 120, seed, holes)
    got = ffill_bfill(df, s, ["x"]).orderBy("id", "t").toPandas()
    raw = df.orderBy("id", "t").toPandas()
    want = raw.groupby("id")["x"].transform(lambda v: v.ffill().bfill())
    assert np.allclose(got["x"].astype(float), want.astype(float), equal_nan=True)


@FEW
@given(seed=st.integers(0, 10**6))
def test_interpolation_matches_pandas(spark, seed):
    df = hot(spark, 120, seed, 0.5)
    got = interpolate_time(df, Series(("id",), "t", "month"), ["x"]).orderBy("id", "t").toPandas()
    raw = df.orderBy("id", "t").toPandas()
    for i, part in raw.groupby("id"):
        v = pd.Series(part["x"].to_numpy(dtype=float), index=pd.to_datetime(part["t"]))
        want = v.interpolate(method="time").ffill().bfill()
        assert np.allclose(got[got["id"] == i]["x"].astype(float), want, equal_nan=True)


@FEW
@given(seed=st.integers(0, 10**6), mode=st.sampled_from(["diff", "log_diff"]))
def test_difference_round_trip(spark, seed, mode):
    s = Series(("id",), "t")
    df = hot(spark, 80, seed).withColumn("raw", F.col("x"))
    d = G.number_rows(I.difference(df, s, ["x"], mode), s, "n")
    first = d.filter("n = 1").select("id", F.col("raw").alias("anchor"))
    d = d.withColumn("x", F.when(F.col("n") > 1, F.col("x")).otherwise(0.0)).join(first, "id")
    out = I.invert_difference(d, s, "x", "anchor", mode)
    assert out.agg(F.max(F.abs(F.col("level") - F.col("raw")))).first()[0] < 1e-9


@FEW
@given(seed=st.integers(0, 10**6))
def test_tokens_are_within_half_a_bin(spark, seed):
    rng = np.random.default_rng(seed)
    df = spark.createDataFrame([(float(x),) for x in rng.uniform(-15, 15, 200)], "x double")
    back = X.detoken(X.token(F.col("x"), F.lit(2.0)), F.lit(2.0))
    worst = df.agg(F.max(F.abs(back - F.col("x")))).first()[0]
    assert worst <= 2.0 * X._step(X.LOW, X.HIGH, X.N_TOKENS, X.N_SPECIAL) / 2 + 1e-12


@pytest.mark.parametrize("accuracy", [50, 1000, 100_000])
def test_exact_percentiles_beyond_the_sketch(spark, accuracy):
    """Far more rows than the sketch's accuracy, with heavy ties: still exact."""
    df = spark.range(20_000).select(
        (F.col("id") % 3 == 0).cast("int").alias("g"),
        F.when(F.col("id") % 5 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**6)) / 1e3).alias("x"))
    qs = [0.0, 0.01, 0.25, 0.5, 0.977, 1.0]
    got = S.exact_percentiles(df, ["g"], "x", qs, accuracy).toPandas().set_index(["g", "q"])["value"]
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        for q in qs:
            assert got[(g, q)] == pytest.approx(np.quantile(part["x"], q), abs=1e-9)


def test_no_task_holds_a_group_of_exact_percentiles(spark):
    """Brackets go to the rows; where they are too many for that, a group's rows are spread over salts."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("double").alias("x"))
    want = df.toPandas().groupby("g").x.quantile([0.25, 0.9])
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        for limit in (before, "-1"):
            spark.conf.set(key, limit)
            out = S.exact_percentiles(df, ["g"], "x", [0.25, 0.9])
            text = out._jdf.queryExecution().executedPlan().toString()
            joins = [line for line in text.split("\n") if "SortMergeJoin" in line]
            assert all("_salt" in line for line in joins) and bool(joins) == (limit == "-1")
            for g, q, v in out.collect():
                assert v == pytest.approx(want[(g, q)], abs=1e-9)
    finally:
        spark.conf.set(key, before)


def test_correlation_matrix_in_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 9)); x[:, 3] = x[:, 1] * 2 + 0.1 * x[:, 3]
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), f"f{j}", float(x[i, j])) for i in range(60) for j in range(9)]
    df = spark.createDataFrame(rows, "t date, feature string, value double")
    want = np.corrcoef(x.T)
    for block in (2, 4, 100):
        got = S.corr_matrix(df, block=block, dates_per_chunk=16).toPandas().pivot(index="f1", columns="f2", values="r")
        assert got.shape == (9, 9) and np.allclose(got.to_numpy(), want)
    diag = S.corr_matrix(df, ddof_scale=True).filter("f1 = f2").agg(F.max("r")).first()[0]
    assert diag == pytest.approx(59 / 60)
