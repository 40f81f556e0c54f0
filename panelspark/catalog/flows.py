"""Whole flows: dataset build, forecast run, covariate selection."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelspark.catalog import query
from panelspark.catalog.indicators import ENRICH_SQL
from panelspark.catalog.inputs import DAY, HOUR, SQL_DAY, SQL_HOUR, bars_day, bars_hour, rnd, table
from panelspark.functions.calendar import calendar_features
from panelspark.operators import windows as X
from panelspark.operators.evaluate import bootstrap
from panelspark.operators.indicators import INDICATORS
from panelspark.plans.dataset import build_dataset
from panelspark.plans.forecast import run_forecast, run_stream_forecast
from panelspark.plans.selection import select_covariates
from panelspark.schema import DatasetSpec

DAILY = """nd as (select date '1998-01-01' + cast((vec_id * vec_id % 61) * 2 as int) t, count(*) n, avg(abs(cast(embedding[1] as double))) p from embeddings group by 1)"""


def _news(spark, sf):
    from panelspark.operators.news import daily_news
    v = F.abs(F.get("embedding", F.lit(0))).cast("double")
    e = table(spark, sf, "embeddings").select(
        F.expr("date_add(date'1998-01-01', cast((vec_id * vec_id % 61) * 2 as int))").alias("t"), "embedding",
        v.alias("prob_positive"), (v / 2).alias("prob_negative"), (v / 3).alias("prob_neutral"))
    return daily_news(e, "t")


FEATURES = ["open", "high", "low", "close", *INDICATORS]
BUILD = f"""with {SQL_DAY}, base as (select * from bars_day), {ENRICH_SQL},
rich as (select id, t, open, high, low, close, Movement, Daily_Return, Volatility, e12 EMA_12, e26 EMA_26, e12 - e26 MACD, RSI, Stoch_K,
  Stoch_D, Williams_R, ROC from c where Movement is not null and Daily_Return is not null and Volatility is not null
  and RSI is not null and Stoch_K is not null and Stoch_D is not null and Williams_R is not null and ROC is not null),
{DAILY}, nf as (select t from nd union select a.t + 1 from nd a join nd b on b.t = a.t + 2),
tg as (select t from rich where id = '1-URGENT'), sp as (select min(t) lo, max(t) hi from tg),
cal as (select t from (select t from tg union select t from nf, sp where t between lo and hi) where t < date '1999-06-01'),
g as (select i.id, cal.t, r.* exclude (id, t) from (select distinct id from rich) i cross join cal left join rich r on r.id = i.id and r.t = cal.t),
long_ as (select id, t, feature, v from g unpivot include nulls (v for feature in ({", ".join(FEATURES)}))),
p as (select *, last_value(case when v is not null then t end ignore nulls) over b tp, last_value(v ignore nulls) over b vp,
  first_value(case when v is not null then t end ignore nulls) over n tn, first_value(v ignore nulls) over n vn from long_
  window b as (partition by id, feature order by t rows between unbounded preceding and current row),
         n as (partition by id, feature order by t rows between current row and unbounded following))
select id || '_' || feature feature, t,
  round(coalesce(v, vp + (vn - vp) * ((t - tp) / nullif(tn - tp, 0)), vp, vn), 5) + 0.0 as value from p
where not (id = '1-URGENT' and feature in ('open', 'high', 'low', 'close'))"""


def _dataset(spark, sf):
    return build_dataset(bars_day(spark, sf), DatasetSpec("1-URGENT"), DAY, _news(spark, sf), dt.date(1999, 6, 1))


@query("build_dataset_features", time="t", sql=BUILD)
def build_dataset_features(spark, sf):
    """Every feature of every series on the shared calendar."""
    return _dataset(spark, sf)["global_features"].select("feature", "t", rnd("value", 5).alias("value"))


@query("build_dataset_news", time="t", sql=BUILD.split("g as (select i.id, cal")[0].rstrip().rstrip(",") + f""",
nn as (select t, p from nd union all select a.t + 1, (a.p + b.p) / 2 from nd a join nd b on b.t = a.t + 2)
select cal.t, round(p, 6) prob_positive, 64 dim from cal left join nn using (t)""")
def build_dataset_news(spark, sf):
    n = _dataset(spark, sf)["news"]
    return n.select("t", rnd("prob_positive").alias("prob_positive"), F.size("embedding").alias("dim"))


def hold(x, pred, mc, seed):
    """No change: zero differences in every member."""
    return np.zeros((mc, pred))


@query("forecast_run", f"""with {SQL_DAY}, n as (select id, t, close, row_number() over (partition by id order by t) rn, count(*) over (partition by id) c from bars_day),
te as (select id, t, close, row_number() over (partition by id order by t) rn, count(*) over (partition by id) c from n where rn > greatest(greatest(c - 100, 0) - 30, 0)),
w as (select a.id, a.rn w, a.close anchor, b.close truth from te a join te b on b.id = a.id and b.rn between a.rn + 1 and a.rn + 7 where a.rn >= 30 and a.rn + 7 <= a.c),
m as (select id, w, avg(pow(truth - anchor, 2)) mse, avg(abs(truth - anchor)) mae from w group by 1, 2)
select id, 'test' split, count(*) windows_evaluated, round(ln(avg(mse)), 6) log_mse, round(ln(avg(mse)), 6) log_mse_naive, round(avg(mae), 2) mae from m group by 1""")
def forecast_run(spark, sf):
    """Zero differences rebuild the anchor price, so the run must score exactly like persistence."""
    out = run_forecast(bars_day(spark, sf), DAY, hold, ctx=30, test=100, val=100, mc=5)["summary"]
    return out.select("id", "split", "windows_evaluated", rnd(F.ln("mse")).alias("log_mse"),
                      rnd(F.ln("mse_naive")).alias("log_mse_naive"), rnd("mae", 2).alias("mae"))


@query("forecast_run_bootstrap")
def forecast_run_bootstrap(spark, sf):
    out = run_forecast(bars_hour(spark, sf), HOUR, bootstrap, ctx=30, test=100, val=100, mc=100,
                       splits=("val", "test"))
    return out["summary"].select("id", "split", "windows_evaluated", "crps", "cov80", "ece_quantiles",
                                 "mse_skill_vs_naive", "dm_test.stat", "dm_test.p_value")


def lean(w, pred, mc, seed):
    """Tokens that follow every stream: the last token, moved up the horizon with the first covariate's
    direction, by the number of days with news, and on days that the calendar marks; members one bin apart."""
    up = 1 if w.covariates[-1, 0] > w.covariates[0, 0] else -1
    path = w.tokens[-1] + up * np.arange(1, pred + 1) + int(w.news.any(axis=1).sum()) + 5 * (w.known[:, 0] > 0.1)
    return path[None, :] + np.arange(mc)[:, None] - mc // 2


_STEP = X._step(X.LOW, X.HIGH, X.N_TOKENS, X.N_SPECIAL)
_BINS = X.N_TOKENS - X.N_SPECIAL - 1
STREAMS_SQL = f"""with {SQL_DAY}, nd as (select distinct date '1998-01-01' + cast((vec_id * vec_id % 61) * 2 as int) t from embeddings),
k0 as (select id, t, close, high, close - lag(close) over w d, row_number() over w rn, count(*) over (partition by id) c
  from bars_day window w as (partition by id order by t)),
k as (select * exclude (d), coalesce(d, lead(d) over (partition by id order by rn)) x from k0),
tr as (select id, avg(abs(x)) g from k where rn <= c - 200 group by 1),
te as (select * exclude (rn, c), row_number() over (partition by id order by rn) rn, count(*) over (partition by id) c
  from k where rn > greatest(greatest(c - 100, 0) - 30, 0)),
f as (select te.*, if(nd.t is null, 0, 1) news, tr.g from te left join nd on nd.t = te.t left join tr on tr.id = te.id),
cx as (select id, rn, c, t, close, x, high, lag(high, 29) over w first_high, avg(abs(x)) over v own, g, sum(news) over v n_news
  from f window w as (partition by id order by rn), v as (partition by id order by rn rows between 29 preceding and current row)),
w as (select *, {{scale}} scale from cx where rn >= 30 and rn + 7 <= c),
st as (select w.id, w.rn w, b.rn - w.rn h, w.close anchor, b.close truth, w.scale,
    least(greatest(floor((w.x / w.scale - {X.LOW!r}) / {_STEP!r} + 0.5) + 1, 1), {_BINS}) + {X.N_SPECIAL}
    + if(w.high > w.first_high, 1, -1) * (b.rn - w.rn) + w.n_news + if(sin((isodow(b.t) - 1) * 2 * pi() / 7) > 0.1, 5, 0) tok
  from w join te b on b.id = w.id and b.rn between w.rn + 1 and w.rn + 7),
m as (select id, w, h, truth, tok, scale, anchor + sum(median) over (partition by id, w order by h rows unbounded preceding) median from (
    select *, (least(greatest(tok - {X.N_SPECIAL + 1}, 0), {_BINS - 1}) * {_STEP!r} + {X.LOW!r}) * scale median from st)),
pw as (select id, w, avg(pow(truth - median, 2)) mse, avg(abs(truth - median)) mae, sum(tok) tok, max(scale) scale from m group by 1, 2)
select id, 'test' split, count(*) windows_evaluated, round(ln(avg(mse)), 6) log_mse, round(avg(mae), 2) mae,
  cast(sum(tok) as bigint) token_sum, round(avg(scale), 4) mean_scale from pw group by 1"""


def _streams(spark, sf, **how):
    bars = bars_day(spark, sf)
    days = bars.select("t").distinct()
    known = days.withColumns(calendar_features("t"))
    out = run_stream_forecast(bars, DAY, lean, covariates=bars.select("id", "t", "high", "low"), known=known, news=_news(spark, sf),
                              dim=64, mode="diff", ctx=30, test=100, val=100, mc=3, **how)
    tokens = out["steps"].groupBy("id", "split").agg(F.sum(F.get("tokens", F.lit(1))).alias("token_sum"),
                                                     rnd(F.avg("scale"), 4).alias("mean_scale"))
    return out["summary"].join(tokens, ["id", "split"]).select("id", "split", "windows_evaluated", rnd(F.ln("mse")).alias("log_mse"),
                                                             rnd("mae", 2).alias("mae"), "token_sum", "mean_scale")


@query("forecast_run_covariates", STREAMS_SQL.format(scale="if(own > 0, own, 1)"))
def forecast_run_covariates(spark, sf):
    """Target, covariates, calendar and news reach the forecaster; its tokens are decoded with each window's scale."""
    return _streams(spark, sf)


@query("forecast_run_global_scale", STREAMS_SQL.format(scale="if(g > 0, g, 1)"))
def forecast_run_global_scale(spark, sf):
    """The same with one scale a series, taken from its training rows."""
    return _streams(spark, sf, global_scale=True)


SEL = f"""with {SQL_HOUR}, f as (select t, id || '_' || feature feature, value from (select id, t, open, high, low, close from bars_hour)
  unpivot (value for feature in (open, high, low, close))),
days as (select t from f where feature like '%close' group by 1), nm as (select distinct feature from f),
g as (select nm.feature, days.t, f.value from nm cross join days left join f using (feature, t)),
fl as (select feature, t, coalesce(last_value(value ignore nulls) over (partition by feature order by t rows between unbounded preceding and current row),
  first_value(value ignore nulls) over (partition by feature order by t rows between current row and unbounded following)) v from g),
d as (select feature, t, ln(v) - lag(ln(v)) over (partition by feature order by t) d from fl),
e as (select feature, t, coalesce(d, lead(d) over (partition by feature order by t)) d from d),
cm as (select a.feature f1, b.feature f2, corr(a.d, b.d) r from e a join e b using (t) group by 1, 2),
kp as (select f1, max(abs(r)) m from cm where f1 not like '%close' and f2 like '%close' group by 1 having max(abs(r)) > 0.25)"""


def _selection(spark, sf):
    from panelspark.operators.align import to_long
    x = to_long(bars_hour(spark, sf), HOUR, ["open", "high", "low", "close"])
    x = x.select("t", F.concat_ws("_", "id", "feature").alias("feature"), "value")
    close = F.col("feature").endswith("close")
    return select_covariates(x.filter(~close), x.filter(close), redundant=0.2)


@query("covariate_selection", SEL + " select f1, round(m, 5) max_abs_r from kp")
def covariate_selection(spark, sf):
    return _selection(spark, sf)["survivors"].select("f1", rnd("max_abs_r", 5).alias("max_abs_r"))


@query("covariate_redundancy", SEL + """ select f1, f2, round(r, 5) + 0.0 r from cm where f1 < f2 and abs(r) > 0.2
  and f1 in (select f1 from kp) and f2 in (select f1 from kp)""")
def covariate_redundancy(spark, sf):
    return _selection(spark, sf)["redundant"].select("f1", "f2", rnd("r", 5).alias("r"))
