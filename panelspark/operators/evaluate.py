"""Scoring ensemble forecasts: quantiles, point, interval and distributional metrics, DM test.

Samples are a long table `(keys.., window, horizon, sample, value)`. One group is the members of
one forecast step, as many as the forecaster drew (100 by default), so gathering a step's members
is bounded by that number and not by the data; everything else is a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.student import t_p_value
from panelspark.operators.segments import lagged_products, row_numbers, running, series_totals
from panelspark.schema import Series

# Interval levels, calibration grid, guards against division by zero.
ALPHAS = {50: 0.5, 80: 0.2, 90: 0.1}
GRID = [round(0.05 * i, 2) for i in range(1, 20)]
EPS_RATIO, EPS_SKILL = 1e-8, 1e-12

METRICS = ["mse", "mae", "smape", "crps", "wis50", "wis80", "wis90", "cov50", "cov80", "cov90",
           "sharp80", "ece_q", "mse_naive", "mae_naive", "pinball_p10", "pinball_p50",
           "pinball_p90"]


def array_quantile(ens, q: float) -> Column:
    """Linear-interpolation quantile of a sorted array."""
    ens = F.col(ens) if isinstance(ens, str) else ens
    h = (F.size(ens) - 1) * F.lit(float(q))
    lo = F.floor(h).cast("int")
    a, b = F.get(ens, lo), F.get(ens, F.least(lo + 1, F.size(ens) - 1))
    return a + (b - a) * (h - lo)


def clean_samples(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Members that are not finite take the mean of the finite members of their group.

    `by` names the window: the mean runs over all its members and steps.
    """
    x = F.col(value)
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.when(ok, x)
    return samples.withColumn(value, F.coalesce(good, F.avg(good).over(Window.partitionBy(*by))))


def sample_stats(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Range of the finite members and how many are not finite, for a bad score's report."""
    x = F.col(value)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.when(~bad, x)
    return samples.groupBy(*by).agg(F.min(good).alias("min"), F.avg(good).alias("mean"),
                                    F.max(good).alias("max"),
                                    F.sum(bad.cast("int")).alias("n_not_finite"))


def reconstruct(samples: DataFrame, anchors: DataFrame, by: list[str], mode: str) -> DataFrame:
    """Difference-space members to levels along the horizon, from each window's anchor price."""
    if mode == "no_diff":
        return samples
    run = F.sum("value").over(Window.partitionBy(*by, "window", "sample").orderBy("horizon")
                              .rowsBetween(Window.unboundedPreceding, 0))
    level = (F.col("anchor") * F.exp(run) if mode == "log_diff" else F.col("anchor") + run)
    return (samples.join(anchors.select(*by, "window", "anchor"), [*by, "window"])
            .withColumn("value", level).drop("anchor"))


def ensembles(samples: DataFrame, by: list[str]) -> DataFrame:
    """The sorted members of each step as an array."""
    return samples.groupBy(*by, "window", "horizon").agg(
        F.sort_array(F.collect_list("value")).alias("ens"))


def ensemble_quantiles(samples: DataFrame, by: list[str], qs: list[float] = GRID) -> DataFrame:
    """Long table of quantiles per step: (.., window, horizon, q, value)."""
    e = ensembles(samples, by)
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("q"), array_quantile("ens", q).alias("value"))
                      for q in qs])
    return e.select(*by, "window", "horizon", F.explode(pairs).alias("p")).select(
        *by, "window", "horizon", "p.*")


# ── per-step scores ─────────────────────────────────────────────────────────
def interval_score(y: Column, low: Column, high: Column, alpha: float) -> Column:
    zero = F.lit(0.0)
    return ((high - low) + (2 / alpha) * F.greatest(low - y, zero)
            + (2 / alpha) * F.greatest(y - high, zero))


def pinball(y: Column, forecast: Column, q: float) -> Column:
    e = y - forecast
    return F.greatest(q * e, (q - 1) * e)


def smape(y: Column, f: Column) -> Column:
    return 200.0 * F.abs(f - y) / (F.abs(y) + F.abs(f) + EPS_RATIO)


def mape(y: Column, f: Column) -> Column:
    return 100.0 * F.abs((f - y) / (F.abs(y) + EPS_RATIO))


def crps(ens, y: Column) -> Column:
    """Ensemble CRPS from the sorted members: mean |x - y| minus half the mean pair distance.

    The pair term is a weighted sum over ranks, so no member meets every other one.
    """
    ens = F.col(ens) if isinstance(ens, str) else ens
    m = F.size(ens).cast("double")
    near = F.aggregate(ens, F.lit(0.0), lambda a, x: a + F.abs(x - y)) / m
    ranked = F.aggregate(F.transform(ens, lambda x, i: (2 * (i + 1) - m - 1) * x), F.lit(0.0),
                         lambda a, x: a + x)
    return near - ranked / (m * m)


def pit(ens, y: Column) -> Column:
    """(members <= truth + 1) / (members + 1)."""
    ens = F.col(ens) if isinstance(ens, str) else ens
    return (F.size(F.filter(ens, lambda x: x <= y)) + 1.0) / (F.size(ens) + 1.0)


def score_steps(samples: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Every per-step quantity from one shuffle of the samples.

    `truth(keys.., window, horizon, truth, naive[, t])`. Adds quantiles, interval ends, losses,
    CRPS, PIT, and one calibration indicator per grid level.
    """
    return score_ensembles(ensembles(samples, by).join(truth, [*by, "window", "horizon"]))


def score_ensembles(s: DataFrame) -> DataFrame:
    """The same for steps that hold their sorted members `ens`, their `truth` and `naive` forecast."""
    y, med = F.col("truth"), F.col("median")
    ends = {"median": array_quantile("ens", 0.5), "q10": array_quantile("ens", 0.1),
            "q50": array_quantile("ens", 0.5), "q90": array_quantile("ens", 0.9)}
    for level, a in ALPHAS.items():
        ends[f"low{level}"] = array_quantile("ens", a / 2)
        ends[f"high{level}"] = array_quantile("ens", 1 - a / 2)
    s = s.withColumns(ends)
    cols = {"mse": (med - y) * (med - y), "mae": F.abs(med - y), "smape": smape(y, med),
            "mape": mape(y, med), "crps": crps("ens", y), "pit": pit("ens", y),
            "sharp80": F.col("high80") - F.col("low80"),
            "mse_naive": (F.col("naive") - y) * (F.col("naive") - y),
            "mae_naive": F.abs(F.col("naive") - y)}
    for level, a in ALPHAS.items():
        lo, hi = F.col(f"low{level}"), F.col(f"high{level}")
        cols[f"wis{level}"] = interval_score(y, lo, hi, a)
        cols[f"cov{level}"] = y.between(lo, hi).cast("double")
    for q in (10, 50, 90):
        cols[f"pinball_p{q}"] = pinball(y, F.col(f"q{q}"), q / 100)
    cols["_below"] = F.array(*[(y <= array_quantile("ens", q)).cast("double") for q in GRID])
    return s.withColumns(cols).drop("ens")


def ece(below: str = "_below") -> Column:
    """Mean distance between nominal and empirical frequency over the grid."""
    gaps = [F.abs(F.avg(F.get(below, F.lit(i))) - q) for i, q in enumerate(GRID)]
    return sum(gaps[1:], gaps[0]) / len(GRID)


def _means() -> list[Column]:
    return [ece().alias(m) if m == "ece_q" else F.avg(m).alias(m) for m in METRICS]


def per_window_metrics(steps: DataFrame, by: list[str], trading_only: bool = False) -> DataFrame:
    """The 17 metrics of each window; optionally only over steps on trading days."""
    if trading_only:
        steps = steps.filter(F.col("trading_day") == 1)
    return steps.groupBy(*by, "window").agg(*_means())


def per_horizon_metrics(steps: DataFrame, by: list[str]) -> DataFrame:
    """The same metrics per step ahead, CRPS and calibration included."""
    return steps.groupBy(*by, "horizon").agg(*_means())


def forecast_table(steps: DataFrame, by: list[str]) -> DataFrame:
    return steps.select(*by, "window", "horizon", *[c for c in ("t",) if c in steps.columns],
                        "truth", "median", "low80", "high80", "q10", "q50", "q90", "naive")


def reliability_curve(forecasts: DataFrame, by: list[str], grid: list[float] = GRID) -> DataFrame:
    """Empirical frequency of truth <= quantile, the quantile interpolated between 10, 50, 90 %."""
    aggs = []
    for i, q in enumerate(grid):
        lo, hi, w = (("q10", "q50", (q - 0.1) / 0.4) if q < 0.5 else ("q50", "q90", (q - 0.5) / 0.4))
        exact = {0.1: "q10", 0.5: "q50", 0.9: "q90"}.get(round(q, 6))
        f = F.col(exact) if exact else (1 - w) * F.col(lo) + w * F.col(hi)
        aggs.append(F.avg((F.col("truth") <= f).cast("double")).alias(f"e{i}"))
    rows = forecasts.groupBy(*by).agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("nominal"), F.col(f"e{i}").alias("empirical"))
                      for i, q in enumerate(grid)])
    return rows.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*")


def limit_windows(df: DataFrame, n: int) -> DataFrame:
    """The first n windows of a run, when asked to score only those."""
    return df.filter(F.col("window") <= n)


# ── run summary and significance ────────────────────────────────────────────
def dm_test(losses: DataFrame, by: list[str], loss1: str = "mse", loss2: str = "mse_naive",
            h: int = 1, order: str = "window") -> DataFrame:
    """Diebold-Mariano on per-window losses: mean difference over its Newey-West deviation.

    Differences are centred in the pass that numbers the windows; the products up to h - 1 positions
    apart are summed in overlapping segments, one exchange whatever h.
    """
    windows = Series(tuple(by), order)
    d = losses.select(*by, order, (F.col(loss1) - F.col(loss2)).alias("_d"))
    d = running(d, windows, row_numbers(windows, count="n"), series_totals(windows, "_d", "d"))
    d = d.withColumn("_c", F.col("_d") - F.col("d_mean")).withColumnRenamed("d_mean", "mean_diff")
    sums = lagged_products(d, windows, "_c", list(range(h)), ["n", "d_count", "mean_diff"])
    part = F.when(F.col("lag") == 0, F.col("total"))
    out = sums.groupBy(*by).agg(
        F.coalesce(F.first("n"), F.lit(0)).alias("n"), F.first("mean_diff").alias("mean_diff"),
        F.try_divide(F.max(part), F.first("d_count")).alias("_g0"),
        (F.sum(F.when(F.col("lag") > 0, 2 * (1 - F.col("lag") / h) * F.col("total")).otherwise(0.0)) / F.first("n")).alias("_cov"))
    var = F.col("_g0") + F.col("_cov")
    under = F.try_divide(var, F.col("n")) + EPS_SKILL
    stat = F.when(under > 0, F.col("mean_diff") / F.sqrt(F.greatest(under, F.lit(0.0))))
    out = out.withColumn("stat", stat)
    out = out.withColumn("p_value", t_p_value("stat", F.greatest(F.col("n") - 1, F.lit(1)).cast("double")))
    return out.select(*by, "n", "stat", "p_value", F.lit(h).alias("h"))


def summarise(windows: DataFrame, by: list[str], h: int) -> DataFrame:
    """Run-level means, skill against persistence, and the DM test as a nested struct."""
    names = {"ece_q": "ece_quantiles"}
    aggs = [F.avg(m).alias(names.get(m, m)) for m in METRICS if not m.startswith("pinball")]
    out = windows.groupBy(*by).agg(F.count(F.lit(1)).alias("windows_evaluated"), *aggs)
    out = out.withColumns({
        "mse_skill_vs_naive": 1 - F.col("mse") / (F.col("mse_naive") + EPS_SKILL),
        "mae_skill_vs_naive": 1 - F.col("mae") / (F.col("mae_naive") + EPS_SKILL)})
    dm = dm_test(windows, by, h=h)
    body = F.struct("stat", "p_value", "h").alias("dm_test")
    if by:
        return out.join(dm.select(*by, body), by)
    return out.withColumn("dm_test", dm.select(body).scalar())


# ── forecaster hook ─────────────────────────────────────────────────────────
def forecast(windows: DataFrame, keys: list[str], fn: Callable[[np.ndarray, int, int, int], np.ndarray],
             pred: int, mc: int = 100, seed: int = 0) -> DataFrame:
    """Samples from a user forecaster: `fn(context, pred, mc, seed) -> (mc, pred)`.

    The seed mixes the window number with the given one, so a retried task draws the same.
    """
    spark_types = dict(windows.dtypes)
    schema = ", ".join(f"`{k}` {spark_types[k]}" for k in keys)
    src = windows.select(*keys, "window", "x",
                         F.pmod(F.xxhash64(*keys, "window", F.lit(seed)), F.lit(2**31)).alias("draw_seed"))

    def run(frames, rows_at_once=256):
        horizon = np.tile(np.arange(1, pred + 1, dtype="int32"), mc)
        member = np.repeat(np.arange(mc, dtype="int32"), pred)
        for pdf in frames:
            for at in range(0, len(pdf), rows_at_once):
                part = pdf.iloc[at:at + rows_at_once]
                draws = []
                for x, own in zip(part["x"], part["draw_seed"]):
                    d = np.asarray(fn(np.asarray(x, dtype=float), pred, mc, int(own)), dtype=float)
                    if d.shape != (mc, pred):
                        raise ValueError(f"forecaster returned {d.shape}, wanted {(mc, pred)}")
                    draws.append(d.ravel())
                out = part[[*keys, "window"]].loc[part.index.repeat(mc * pred)]
                yield out.assign(horizon=np.tile(horizon, len(part)),
                                 sample=np.tile(member, len(part)), value=np.concatenate(draws))

    return src.mapInPandas(run, f"{schema}, window bigint, horizon int, sample int, value double")


def forecast_ensembles(windows: DataFrame, keys: list[str], fn: Callable[[np.ndarray, int, int, int], np.ndarray],
                       pred: int, mc: int = 100, seed: int = 0, mode: str = "no_diff", anchor: str | None = None,
                       truth: str = "y") -> DataFrame:
    """Steps ready for `score_ensembles`: (keys, window, horizon, ens, truth, naive).

    Members never leave the batch that draws them: what is not finite takes the mean of the window's
    finite members, differences are summed along the horizon onto the anchor, members are sorted, and
    one row per step comes out with its truth. The same draws as `forecast`; without an anchor column
    the last context value is the naive forecast.
    """
    if mode != "no_diff" and anchor is None:
        raise ValueError("differences need an anchor column")
    types = dict(windows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    base = F.col(anchor) if anchor else F.element_at("x", -1)
    src = windows.select(*keys, "window", "x", F.col(truth).alias("_truth"), base.cast("double").alias("_naive"),
                         F.pmod(F.xxhash64(*keys, "window", F.lit(seed)), F.lit(2**31)).alias("draw_seed"))

    def members(x, own, naive) -> np.ndarray:
        d = np.asarray(fn(np.asarray(x, dtype=float), pred, mc, int(own)), dtype=float)
        if d.shape != (mc, pred):
            raise ValueError(f"forecaster returned {d.shape}, wanted {(mc, pred)}")
        good = np.isfinite(d)
        if not good.all():
            d = np.where(good, d, d[good].mean() if good.any() else np.nan)
        if mode == "log_diff":
            d = naive * np.exp(d.cumsum(axis=1))
        elif mode != "no_diff":
            d = naive + d.cumsum(axis=1)
        return np.sort(d, axis=0)

    def run(frames, rows_at_once=256):
        for pdf in frames:
            for at in range(0, len(pdf), rows_at_once):
                part = pdf.iloc[at:at + rows_at_once]
                ens, real = [], []
                for x, own, naive, y in zip(part["x"], part["draw_seed"], part["_naive"], part["_truth"]):
                    d = members(x, own, naive)
                    ens += [c[~np.isnan(c)] for c in d.T]
                    real += list(y)
                out = part[[*keys, "window"]].loc[part.index.repeat(pred)]
                yield out.assign(horizon=np.tile(np.arange(1, pred + 1, dtype="int32"), len(part)), ens=ens, truth=real,
                                 naive=np.repeat(part["_naive"].to_numpy(), pred))

    return src.mapInPandas(run, f"{schema}, window bigint, horizon int, ens array<double>, truth double, naive double")


def persistence(x: np.ndarray, pred: int, mc: int, seed: int) -> np.ndarray:
    """The last value, in every member."""
    return np.full((mc, pred), x[-1])


def bootstrap(x: np.ndarray, pred: int, mc: int, seed: int) -> np.ndarray:
    """Paths that add past differences drawn with replacement to the last value."""
    rng = np.random.default_rng(seed)
    steps = rng.choice(np.diff(x), size=(mc, pred), replace=True)
    return x[-1] + steps.cumsum(axis=1)
