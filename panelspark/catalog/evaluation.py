"""Forecast samples and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog import query
from panelspark.catalog.inputs import HOUR, SQL_HOUR, bars_hour, rnd, table
from panelspark.operators import evaluate as E
from panelspark.operators import stats as S
from panelspark.operators import windows as X
from panelspark.session import stage

M = 8


def samples(spark, sf):
    """Eight steps of eight members per embedding vector."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select((F.col("vec_id") + 1).alias("window"), (F.col("i") % 8 + 1).alias("horizon"),
                    F.expr("cast(i div 8 as int)").alias("sample"), F.col("v").cast("double").alias("value"))


def truths(spark, sf):
    """Truth is the first member of the next vector, persistence the last step of this one."""
    first = samples(spark, sf).filter("sample = 0")
    truth = first.select((F.col("window") - 1).alias("window"), "horizon", F.col("value").alias("truth"))
    naive = first.filter("horizon = 8").select("window", F.col("value").alias("naive"))
    t = F.expr("date_add(date'2024-01-01', cast(window + horizon as int))").alias("t")
    return truth.join(naive, "window").select("window", "horizon", "truth", "naive", t)


def steps(spark, sf):
    return E.score_steps(samples(spark, sf), truths(spark, sf), [])


SM = """sm as (select vec_id + 1 w, cast((i - 1) % 8 + 1 as integer) h, cast((i - 1) // 8 as integer) s, cast(embedding[i] as double) v
  from embeddings, generate_series(1, 64) g(i))"""


def q_sql(q: float, ens: str = "ens") -> str:
    h = f"({M - 1} * cast({q!r} as double))"
    lo = f"cast(floor({h}) as integer)"
    return f"({ens}[{lo} + 1] + ({ens}[least({lo} + 2, {M})] - {ens}[{lo} + 1]) * ({h} - {lo}))"


def wis(lo, hi, a):
    return f"({hi} - {lo}) + {2 / a!r} * greatest({lo} - truth, 0) + {2 / a!r} * greatest(truth - {hi}, 0)"


def pin(q, c):
    return f"greatest({q} * (truth - {c}), ({q} - 1) * (truth - {c}))"


ST = f"""{SM}, tr as (select w - 1 w, h, v truth from sm where s = 0), nv as (select w, v naive from sm where s = 0 and h = 8),
en as (select w, h, truth, naive, list_sort(list(v)) ens from sm join tr using (w, h) join nv using (w) group by all),
st as (select *, {q_sql(0.5)} median, {q_sql(0.1)} q10, {q_sql(0.9)} q90, {q_sql(0.25)} low50, {q_sql(0.75)} high50,
  {q_sql(0.1)} low80, {q_sql(0.9)} high80, {q_sql(0.05)} low90, {q_sql(0.95)} high90,
  list_avg(list_transform(ens, lambda x: abs(x - truth)))
    - list_sum(list_transform(ens, lambda a: list_sum(list_transform(ens, lambda b: abs(a - b))))) / (2 * {M * M}) crps,
  (len(list_filter(ens, lambda x: x <= truth)) + 1) / cast({M + 1} as double) pit from en),
lo as (select w, h, pow(median - truth, 2) mse, abs(median - truth) mae,
  200 * abs(median - truth) / (abs(truth) + abs(median) + 1e-8) smape, 100 * abs((median - truth) / (abs(truth) + 1e-8)) mape, crps, pit,
  {wis("low50", "high50", 0.5)} wis50, {wis("low80", "high80", 0.2)} wis80, {wis("low90", "high90", 0.1)} wis90,
  cast(truth between low50 and high50 as int) cov50, cast(truth between low80 and high80 as int) cov80,
  cast(truth between low90 and high90 as int) cov90, high80 - low80 sharp80, pow(naive - truth, 2) mse_naive,
  abs(naive - truth) mae_naive, {pin(0.1, "q10")} pinball_p10, {pin(0.5, "median")} pinball_p50, {pin(0.9, "q90")} pinball_p90 from st)"""


def grid_sql(by: str) -> str:
    unions = " union all ".join(
        f"select w, h, {q} q, cast(truth <= {q_sql(q)} as int) below from st" for q in E.GRID)
    return f"gr as ({unions}), ge as (select {by}, q, abs(avg(below) - q) gap from gr group by {by}, q), ec as (select {by}, avg(gap) ece_q from ge group by {by})"


PLAIN = [m for m in E.METRICS if m != "ece_q"]


def means_sql(by: str) -> str:
    cols = ", ".join(f"round(avg({m}), 6) + 0.0 {m}" for m in PLAIN)
    name = {"w": '"window"', "h": "horizon"}[by]
    return f"""with {ST}, {grid_sql(by)}
select {by} as {name}, {cols}, round(max(ece_q), 6) ece_q from lo join ec using ({by}) group by {by}"""


@query("ensemble_quantiles", "with " + SM + """
select w as "window", h horizon, q, round(quantile_cont(v, [""" + ", ".join(map(repr, E.GRID)) + """])[i], 6) + 0.0 as value
from sm, (select unnest([""" + ", ".join(map(repr, E.GRID)) + """])::double q, unnest(range(1, 20)) i) g group by w, h, q, i""")
def ensemble_quantiles(spark, sf):
    return E.ensemble_quantiles(samples(spark, sf), []).select("window", "horizon", "q", rnd("value").alias("value"))


@query("reconstruct_levels", f"""with {SM}, c as (select w, h, s, sum(v) over (partition by w, s order by h) run from sm)
select w as "window", h horizon, s sample, round((100 + w % 10) * exp(run), 4) log_level, round(100 + w % 10 + run, 6) diff_level from c""")
def reconstruct_levels(spark, sf):
    s = samples(spark, sf)
    a = s.select("window").distinct().withColumn("anchor", (100 + F.col("window") % 10).cast("double"))
    keys = ["window", "horizon", "sample"]
    log = E.reconstruct(s, a, [], "log_diff").select(*keys, rnd("value", 4).alias("log_level"))
    diff = E.reconstruct(s, a, [], "diff").select(*keys, rnd("value").alias("diff_level"))
    return log.join(diff, keys)


@query("point_metrics", f"""with {ST} select w as "window", h horizon, round(mse, 6) mse, round(mae, 6) mae, round(smape, 4) smape from lo""")
def point_metrics(spark, sf):
    return steps(spark, sf).select("window", "horizon", rnd("mse").alias("mse"), rnd("mae").alias("mae"),
                                   rnd("smape", 4).alias("smape"))


@query("mape", f"""with {ST} select h horizon, round(ln(avg(mape)), 5) log_mape from lo group by 1""")
def mape(spark, sf):
    return steps(spark, sf).groupBy("horizon").agg(rnd(F.ln(F.avg("mape")), 5).alias("log_mape"))


@query("interval_metrics", f"""with {ST}
select w as "window", h horizon, round(wis50, 6) wis50, round(wis80, 6) wis80, round(wis90, 6) wis90, cov50, cov80, cov90, round(sharp80, 6) sharp80 from lo""")
def interval_metrics(spark, sf):
    s = steps(spark, sf)
    return s.select("window", "horizon", *[rnd(c).alias(c) for c in ("wis50", "wis80", "wis90", "sharp80")],
                    *[F.col(c).cast("int").alias(c) for c in ("cov50", "cov80", "cov90")])


@query("pinball_loss", f"""with {ST} select w as "window", h horizon, round(pinball_p10, 6) p10, round(pinball_p50, 6) p50, round(pinball_p90, 6) p90 from lo""")
def pinball_loss(spark, sf):
    return steps(spark, sf).select("window", "horizon", *[rnd(f"pinball_p{q}").alias(f"p{q}") for q in (10, 50, 90)])


@query("crps", f"""with {ST} select w as "window", h horizon, round(crps, 6) crps from lo""")
def crps(spark, sf):
    return steps(spark, sf).select("window", "horizon", rnd("crps").alias("crps"))


@query("pit_values", f"""with {ST} select w as "window", h horizon, round(pit, 6) pit from lo""")
def pit_values(spark, sf):
    return steps(spark, sf).select("window", "horizon", rnd("pit").alias("pit"))


@query("pit_histogram", f"""with {ST}, b as (select least(floor(pit * 20 + 1e-9), 19) bin, count(*) n from lo group by 1)
select i bin, coalesce(n, 0) n, round(coalesce(n, 0) * 20 / cast((select count(*) from lo) as double), 6) density from generate_series(0, 19) g(i) left join b on bin = i""")
def pit_histogram(spark, sf):
    out = S.histogram(steps(spark, sf), "pit", 20, F.lit(0.0), F.lit(1.0), density=True)
    return out.select("bin", "n", rnd("density").alias("density"))


@query("calibration_error", f"""with {ST}, {grid_sql("w")} select w as "window", round(ece_q, 6) ece_q from ec""")
def calibration_error(spark, sf):
    return steps(spark, sf).groupBy("window").agg(rnd(E.ece()).alias("ece_q"))


@query("reliability_curve", f"""with {ST} {"".join(f", r{i} as (select cast({q} as double) nominal, avg(cast(truth <= (case when {q} = 0.1 then q10 when {q} = 0.5 then median when {q} = 0.9 then q90 when {q} < 0.5 then (1 - ({q} - 0.1) / 0.4) * q10 + ({q} - 0.1) / 0.4 * median else (1 - ({q} - 0.5) / 0.4) * median + ({q} - 0.5) / 0.4 * q90 end) as int)) empirical from st)" for i, q in enumerate(E.GRID))}
select nominal, round(empirical, 6) empirical from ({" union all ".join(f"select * from r{i}" for i in range(19))})""")
def reliability_curve(spark, sf):
    out = E.reliability_curve(E.forecast_table(steps(spark, sf), []), [])
    return out.select("nominal", rnd("empirical").alias("empirical"))


@query("per_window_metrics", means_sql("w"))
def per_window_metrics(spark, sf):
    out = E.per_window_metrics(steps(spark, sf), [])
    return out.select("window", *[rnd(m).alias(m) for m in E.METRICS])


@query("per_horizon_metrics", means_sql("h"))
def per_horizon_metrics(spark, sf):
    out = E.per_horizon_metrics(steps(spark, sf), [])
    return out.select("horizon", *[rnd(m).alias(m) for m in E.METRICS])


@query("forecast_table", time="t", sql=f"""with {ST}
select w as "window", h horizon, date '2024-01-01' + cast(w + h as int) t, round(truth, 6) + 0.0 truth, round(median, 6) + 0.0 median, round(low80, 6) + 0.0 low80,
  round(high80, 6) + 0.0 high80, round(q10, 6) + 0.0 q10, round(median, 6) + 0.0 q50, round(q90, 6) + 0.0 q90, round(naive, 6) + 0.0 naive from st""")
def forecast_table(spark, sf):
    out = E.forecast_table(steps(spark, sf), [])
    return out.select("window", "horizon", "t", *[rnd(c).alias(c) for c in
                                                  ("truth", "median", "low80", "high80", "q10", "q50", "q90", "naive")])


@query("trading_window_metrics", f"""with {ST}
select w as "window", round(avg(mse), 6) mse, round(avg(crps), 6) crps from lo where isodow(date '2024-01-01' + cast(w + h as int)) < 6 group by 1""")
def trading_window_metrics(spark, sf):
    """Windows scored on trading days only, so filled days do not flatter the forecast."""
    s = steps(spark, sf).withColumn("trading_day", (F.weekday("t") < 5).cast("int"))
    return E.per_window_metrics(s, [], trading_only=True).select("window", rnd("mse").alias("mse"), rnd("crps").alias("crps"))


@query("first_windows", f"""with {ST} select w as "window", round(avg(mse), 6) mse from lo where w <= 100 group by 1""")
def first_windows(spark, sf):
    out = E.per_window_metrics(E.limit_windows(steps(spark, sf), 100), [])
    return out.select("window", rnd("mse").alias("mse"))


DM = f"""{ST}, pw as (select w, avg(mse) - avg(mse_naive) d from lo group by 1), mu as (select avg(d) m, count(*) n from pw),
g as (select b.w - a.w k, sum((a.d - m) * (b.d - m)) / max(n) g from pw a join pw b on b.w - a.w between 0 and 7, mu group by 1),
dm as (select max(n) n, max(m) / sqrt(sum(case when k = 0 then g else 2 * (1 - k / 8.0) * g end) / max(n) + 1e-12) stat from g, mu)"""


@query("dm_statistic", f"""with {DM} select n, round(stat, 6) stat from dm""")
def dm_statistic(spark, sf):
    w = stage(E.per_window_metrics(steps(spark, sf), []), "window-metrics")
    return E.dm_test(w, [], h=8).select("n", rnd("stat").alias("stat"))


@query("run_summary", f"""with {DM}, {grid_sql("w")},
pm as (select w, {", ".join(f"avg({m}) {m}" for m in PLAIN)}, max(ece_q) ece_q from lo join ec using (w) group by 1)
select count(*) windows_evaluated, {", ".join(f"round(avg({m}), 6) + 0.0 {m}" for m in PLAIN if not m.startswith("pinball"))}, round(avg(ece_q), 6) ece_quantiles,
  round(1 - avg(mse) / (avg(mse_naive) + 1e-12), 6) mse_skill_vs_naive, round(1 - avg(mae) / (avg(mae_naive) + 1e-12), 6) mae_skill_vs_naive,
  (select round(stat, 6) from dm) dm_stat from pm""")
def run_summary(spark, sf):
    w = stage(E.per_window_metrics(steps(spark, sf), []), "window-metrics")
    out = E.summarise(w, [], h=8)
    plain = [c for c in out.columns if c not in ("windows_evaluated", "dm_test")]
    return out.select("windows_evaluated", *[rnd(c).alias(c) for c in plain], rnd("dm_test.stat").alias("dm_stat"))


@query("dm_p_value")
def dm_p_value(spark, sf):
    w = stage(E.per_window_metrics(steps(spark, sf), []), "window-metrics")
    return E.dm_test(w, [], h=8)


NAN_SQL = f"""{SM}, d as (select *, (w * 7 + h * 3 + s) % 11 = 0 bad from sm)"""


@query("clean_samples", f"""with {NAN_SQL}
select w as "window", h horizon, s sample, round(case when bad then avg(case when not bad then v end) over (partition by w) else v end, 6) + 0.0 as value from d""")
def clean_samples(spark, sf):
    bad = (F.col("window") * 7 + F.col("horizon") * 3 + F.col("sample")) % 11 == 0
    s = samples(spark, sf).withColumn("value", F.when(bad, float("nan")).otherwise(F.col("value")))
    return E.clean_samples(s, ["window"]).select("window", "horizon", "sample", rnd("value").alias("value"))


@query("sample_stats", f"""with {NAN_SQL}
select w as "window", round(min(case when not bad then v end), 6) min, round(avg(case when not bad then v end), 6) + 0.0 mean,
  round(max(case when not bad then v end), 6) max, cast(sum(cast(bad as int)) as bigint) n_not_finite from d group by 1""")
def sample_stats(spark, sf):
    bad = (F.col("window") * 7 + F.col("horizon") * 3 + F.col("sample")) % 11 == 0
    s = samples(spark, sf).withColumn("value", F.when(bad, float("inf")).otherwise(F.col("value")))
    out = E.sample_stats(s, ["window"])
    return out.select("window", *[rnd(c).alias(c) for c in ("min", "mean", "max")], "n_not_finite")


CTX, PRED = 30, 7
WIN = f"""{SQL_HOUR}, r as (select id, t, close, row_number() over (partition by id order by t) rn,
  lag(close) over (partition by id order by t) prev, lead(close, {PRED - 1}) over (partition by id order by t) last_y from bars_hour),
win as (select id, rn - {CTX} w, prev from r where rn > {CTX} and last_y is not null)"""


def _win(spark, sf):
    return X.sliding_windows(bars_hour(spark, sf), HOUR, CTX, PRED)


@query("forecast_persistence", f"""with {WIN}
select id, w as "window", cast(h as integer) horizon, cast(m as integer) sample, round(prev, 6) as value
from win, generate_series(1, {PRED}) a(h), generate_series(0, 3) b(m)""")
def forecast_persistence(spark, sf):
    out = E.forecast(_win(spark, sf), ["id"], E.persistence, PRED, mc=4)
    return out.select("id", "window", "horizon", "sample", rnd("value").alias("value"))


@query("forecast_bootstrap_scores")
def forecast_bootstrap_scores(spark, sf):
    """The whole scoring chain on sampled paths: windows, samples, scores, run summary per series."""
    win = stage(_win(spark, sf), "windows")
    s = E.score_ensembles(E.forecast_ensembles(win, ["id"], E.bootstrap, PRED, mc=100, seed=7))
    w = stage(E.per_window_metrics(s, ["id"]), "window-metrics")
    out = E.summarise(w, ["id"], h=PRED)
    return out.select("id", "windows_evaluated", "crps", "mse", "mse_naive", "mse_skill_vs_naive",
                      F.col("dm_test.stat").alias("dm_stat"), F.col("dm_test.p_value").alias("dm_p"))
