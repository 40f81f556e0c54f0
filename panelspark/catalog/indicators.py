"""Bars and indicators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelspark.catalog import query
from panelspark.catalog.inputs import DAY, HOUR, SQL_DAY, SQL_HOUR, bars_day, bars_hour, rnd
from panelspark.operators import indicators as I
from panelspark.operators.segments import rolled, row_numbers, running
from panelspark.session import stage

W = "over (partition by id order by t)"


def frame(n: int) -> str:
    return f"over (partition by id order by t rows between {n - 1} preceding and current row)"


def full(agg: str, col: str, n: int) -> str:
    return f"case when count({col}) {frame(n)} = {n} then {agg} {frame(n)} end"


def rsi_sql(delta: str, n: int) -> str:
    up = full(f"avg(case when {delta} > 0 then {delta} when {delta} is not null then 0 end)", delta, n)
    dn = full(f"avg(case when {delta} < 0 then -{delta} when {delta} is not null then 0 end)", delta, n)
    return f"case when ({dn}) = 0 then 100.0 else 100 - 100 / (1 + ({up}) / nullif(({dn}), 0)) end"


def ema_sql(col: str, span: int) -> str:
    a = 2 / (span + 1)
    return (f"list_reduce(list({col}) over (partition by id order by t rows unbounded preceding), "
            f"lambda acc, v: acc * cast({1 - a!r} as double) + v * cast({a!r} as double))")


CAL_SQL = """sin(isodow_ * 2 * pi() / 7) sin_dow, cos(isodow_ * 2 * pi() / 7) cos_dow,
  sin(month(t) * 2 * pi() / 12) sin_month, cos(month(t) * 2 * pi() / 12) cos_month,
  sin(dayofyear(t) * 2 * pi() / 365) sin_doy, cos(dayofyear(t) * 2 * pi() / 365) cos_doy"""

CAL_NAMES = ["sin_dow", "cos_dow", "sin_month", "cos_month", "sin_doy", "cos_doy"]


@query("bars_hourly", time="t", sql=f"""with {SQL_HOUR}
select id, t, round(open, 6) as open, round(high, 6) high, round(low, 6) low,
       round(close, 6) as close, volume from bars_hour""")
def bars_hourly(spark, sf):
    cols = ["open", "high", "low", "close"]
    return bars_hour(spark, sf).select("id", "t", *[rnd(c).alias(c) for c in cols], "volume")


@query("bars_daily", time="t", sql=f"""with {SQL_DAY}
select id, t, round(open, 4) as open, round(high, 4) high, round(low, 4) low,
       round(close, 4) as close, volume from bars_day""")
def bars_daily(spark, sf):
    cols = ["open", "high", "low", "close"]
    return bars_day(spark, sf).select("id", "t", *[rnd(c, 4).alias(c) for c in cols], "volume")


@query("indicator_lag_movement_return", time="t", sql=f"""with {SQL_HOUR}
select id, t, round(lag(close) {W}, 6) as close_lag1,
  round((open - lag(close) {W}) / nullif(lag(close) {W}, 0), 6) movement,
  round((close / nullif(lag(close) {W}, 0) - 1) * 100, 6) daily_return,
  round((close / nullif(lag(close, 10) {W}, 0) - 1) * 100, 6) roc
from bars_hour""")
def lag_movement_return(spark, sf):
    out = rolled(bars_hour(spark, sf), HOUR, lambda w: {
        "close_lag1": I.lag1("close", w), "movement": I.movement("open", "close", w),
        "daily_return": I.daily_return("close", w), "roc": I.roc("close", w, 10)}, back=10)
    return out.select("id", "t", *[rnd(c).alias(c) for c in
                                   ("close_lag1", "movement", "daily_return", "roc")])


@query("indicator_volatility", time="t", sql=f"""with {SQL_HOUR},
r as (select *, (close / nullif(lag(close) {W}, 0) - 1) * 100 ret from bars_hour)
select id, t, round({full("stddev_samp(ret)", "ret", 5)}, 6) volatility_5,
  round({full("stddev_samp(ret)", "ret", 30)}, 6) volatility_30 from r""")
def volatility(spark, sf):
    out = rolled(bars_hour(spark, sf), HOUR, lambda w: [
        {"ret": I.daily_return("close", w)},
        {"volatility_5": I.volatility("ret", w, 5), "volatility_30": I.volatility("ret", w, 30)}],
        back=31)
    return out.select("id", "t", rnd("volatility_5").alias("volatility_5"),
                      rnd("volatility_30").alias("volatility_30"))


@query("indicator_ema", time="t", sql=f"""with {SQL_HOUR}
select id, t, round({ema_sql("close", 12)}, 6) ema_12, round({ema_sql("close", 26)}, 6) ema_26,
  round({ema_sql("close", 3)}, 6) ema_3 from bars_hour""")
def ema(spark, sf):
    bars = stage(bars_hour(spark, sf).select("id", "t", "close"), "closes")
    out = I.add_emas(bars, HOUR, "close", {f"ema_{n}": n for n in (3, 12, 26)})
    return out.select("id", "t", *[rnd(f"ema_{n}").alias(f"ema_{n}") for n in (3, 12, 26)])


EMA_HOLES = "case when t = first_t or hour(t) % 5 = 2 or hour(t) in (7, 8) then null else close end"


@query("ema_with_nulls", time="t", sql=f"""with {SQL_HOUR},
f as (select *, min(t) over (partition by id) first_t from bars_hour),
x as (select id, t, {EMA_HOLES} v from f),
g as (select *, list(v) over (partition by id order by t rows unbounded preceding) vs from x)
select id, t, {", ".join(f"""round(list_reduce(list_transform(vs, lambda y: {{'m': y, 'o': cast(1 as double)}}),
  lambda s, y: case when s.m is null then y
    when y.m is null then {{'m': s.m, 'o': s.o * {1 - 2 / (n + 1)!r}}}
    else {{'m': (s.m * s.o * {1 - 2 / (n + 1)!r} + y.m * {2 / (n + 1)!r}) / (s.o * {1 - 2 / (n + 1)!r} + {2 / (n + 1)!r}),
           'o': cast(1 as double)}} end).m, 6) ema_{n}""" for n in (3, 12))}
from g""")
def ema_with_nulls(spark, sf):
    """Leading and inner holes: the mean starts at the first value and is held over holes."""
    b = running(bars_hour(spark, sf).select("id", "t", "close"), HOUR, I.first_valid(HOUR, "t", "first_t"))
    b = stage(b.select("id", "t", F.expr(EMA_HOLES).alias("v")), "holes")
    out = I.add_emas(b, HOUR, "v", {"ema_3": 3, "ema_12": 12})
    return out.select("id", "t", rnd("ema_3").alias("ema_3"), rnd("ema_12").alias("ema_12"))


@query("indicator_macd", time="t", sql=f"""with {SQL_HOUR}
select id, t, round({ema_sql("close", 12)} - {ema_sql("close", 26)}, 6) macd from bars_hour""")
def macd(spark, sf):
    return I.add_macd(stage(bars_hour(spark, sf).select("id", "t", "close"), "closes"), HOUR, "close").select("id", "t", rnd("MACD").alias("macd"))


@query("indicator_rsi", time="t", sql=f"""with {SQL_HOUR},
d as (select *, close - lag(close) {W} delta from bars_hour)
select id, t, round({rsi_sql("delta", 14)}, 6) rsi from d""")
def rsi(spark, sf):
    return I.add_rsi(bars_hour(spark, sf), HOUR, "close").select("id", "t", rnd("RSI").alias("rsi"))


HL = f"{full('max(high)', 'high', 14)}", f"{full('min(low)', 'low', 14)}"


@query("indicator_stochastic", time="t", sql=f"""with {SQL_HOUR},
r as (select *, {HL[0]} hi, {HL[1]} lo from bars_hour),
k as (select *, 100 * (close - lo) / nullif(hi - lo, 0) k from r)
select id, t, round(k, 6) stoch_k, round({full("avg(k)", "k", 3)}, 6) stoch_d from k""")
def stochastic(spark, sf):
    return I.add_stochastic(bars_hour(spark, sf), HOUR).select(
        "id", "t", rnd("Stoch_K").alias("stoch_k"), rnd("Stoch_D").alias("stoch_d"))


@query("indicator_williams_r", time="t", sql=f"""with {SQL_HOUR},
r as (select *, {HL[0]} hi, {HL[1]} lo from bars_hour)
select id, t, round(-100 * (hi - close) / nullif(hi - lo, 0), 6) + 0.0 williams_r from r""")
def williams(spark, sf):
    out = I.indicator(bars_hour(spark, sf), HOUR, "williams_r",
                      lambda w: I.williams_r("high", "low", "close", w), back=14)
    return out.select("id", "t", rnd("williams_r").alias("williams_r"))


@query("rolling_mean_60", time="t", sql=f"""with {SQL_HOUR}
select id, t, round({full("avg(close)", "close", 60)}, 6) mean_60 from bars_hour""")
def rolling_mean(spark, sf):
    out = I.indicator(bars_hour(spark, sf), HOUR, "mean_60",
                      lambda w: I.rolling_mean("close", w, 60), back=60)
    return out.select("id", "t", rnd("mean_60").alias("mean_60"))


ENRICH_SQL = f"""
a as (select *, isodow(t) - 1 isodow_, lag(close) {W} prev, {HL[0]} hi, {HL[1]} lo,
  {ema_sql("close", 12)} e12, {ema_sql("close", 26)} e26 from base),
b as (select *, (open - prev) / nullif(prev, 0) Movement, (close / nullif(prev, 0) - 1) * 100 Daily_Return,
  close - prev delta, 100 * (close - lo) / nullif(hi - lo, 0) Stoch_K,
  -100 * (hi - close) / nullif(hi - lo, 0) Williams_R,
  (close / nullif(lag(close, 10) {W}, 0) - 1) * 100 ROC from a),
c as (select *, {full("stddev_samp(Daily_Return)", "Daily_Return", 5)} Volatility,
  {full("avg(Stoch_K)", "Stoch_K", 3)} Stoch_D, {rsi_sql("delta", 14)} RSI, {CAL_SQL} from b)"""

ENRICH_OUT = ["Movement", "Daily_Return", "Volatility", "EMA_12", "EMA_26", "MACD", "RSI",
              "Stoch_K", "Stoch_D", "Williams_R", "ROC"]


def enrich_sql(base: str, name: str, n: int) -> str:
    expr = {"EMA_12": "e12", "EMA_26": "e26", "MACD": "e12 - e26"}
    cols = ", ".join(f"round({expr.get(c, c)}, {n}) + 0.0 as {c}" for c in ENRICH_OUT)
    cal = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in CAL_NAMES)
    return f"""with {base}, base as (select * from {name}), {ENRICH_SQL}
select id, t, {cols}, {cal} from c
where Movement is not null and Daily_Return is not null and Volatility is not null
  and RSI is not null and Stoch_K is not null and Stoch_D is not null and Williams_R is not null
  and ROC is not null"""


def _enriched(df, s, n):
    out = I.enrich(df, s)
    return out.select("id", "t", *[rnd(c, n).alias(c) for c in ENRICH_OUT],
                      *[rnd(c).alias(c) for c in CAL_NAMES])


@query("enrich_hourly", time="t", sql=enrich_sql(SQL_HOUR, "bars_hour", 6))
def enrich_hourly(spark, sf):
    return _enriched(bars_hour(spark, sf), HOUR, 6)


@query("enrich_daily", time="t", sql=enrich_sql(SQL_DAY, "bars_day", 4))
def enrich_daily(spark, sf):
    return _enriched(bars_day(spark, sf), DAY, 4)


@query("calendar_features", time="t", sql=f"""with days as (
  select distinct cast(o_orderdate as date) t from orders),
x as (select t, isodow(t) - 1 isodow_ from days), y as (select t, {CAL_SQL} from x)
select t, {", ".join(f"round({c}, 6) + 0.0 as {c}" for c in CAL_NAMES)} from y""")
def calendar_features(spark, sf):
    from panelspark.catalog.inputs import table
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("t")).distinct()
    cols = I.calendar_features("t")
    return days.select("t", *[rnd(e).alias(c) for c, e in cols.items()])


DIFF_SQL = f"""with {SQL_HOUR},
v as (select id, t, close, low - 50 as shifted from bars_hour),
p as (select *, min(close) over (partition by id) > 0 cp,
  min(shifted) over (partition by id) > 0 sp from v),
d as (select id, t, close - lag(close) {W} diff_close,
  case when cp then ln(close) - lag(ln(close)) {W} else close - lag(close) {W} end log_close,
  case when sp then ln(greatest(shifted, 1e-300)) - lag(ln(greatest(shifted, 1e-300))) {W}
       else shifted - lag(shifted) {W} end log_shifted from p)
select id, t, round(coalesce(diff_close, lead(diff_close) {W}), 6) + 0.0 diff_close,
  round(coalesce(log_close, lead(log_close) {W}), 6) + 0.0 log_close,
  round(coalesce(log_shifted, lead(log_shifted) {W}), 6) + 0.0 log_shifted from d"""


@query("difference", time="t", sql=DIFF_SQL)
def difference(spark, sf):
    """Plain and log differences; the shifted column holds negatives, so it stays plain."""
    b = bars_hour(spark, sf).select("id", "t", F.col("close").alias("diff_close"),
                                    F.col("close").alias("log_close"),
                                    (F.col("low") - 50).alias("log_shifted"))
    modes = {"log_close": "log_diff", "log_shifted": "log_diff", "diff_close": "diff"}
    out = I.difference(b, HOUR, list(modes), modes)
    return out.select("id", "t", *[rnd(c).alias(c) for c in
                                   ("diff_close", "log_close", "log_shifted")])


INVERT_SQL = f"""with {SQL_HOUR},
d as (select id, t, close, coalesce(close - lag(close) {W}, 0) d,
  coalesce(ln(close) - lag(ln(close)) {W}, 0) l from bars_hour)
select id, t, round(first_value(close) over w + sum(d) over w, 4) from_diff,
  round(first_value(close) over w * exp(sum(l) over w), 4) from_log
from d window w as (partition by id order by t rows unbounded preceding)"""


@query("invert_difference", time="t", sql=INVERT_SQL)
def invert_difference(spark, sf):
    """Differences turned back into levels from each series' first price, both ways."""
    b = running(bars_hour(spark, sf).select("id", "t", "close"), HOUR, row_numbers(HOUR),
                I.first_valid(HOUR, "close", "anchor"))
    b = rolled(b, HOUR, lambda w: {
        "d": F.coalesce(F.col("close") - I.lag1("close", w), F.lit(0.0)),
        "l": F.coalesce(F.ln("close") - F.ln(I.lag1("close", w)), F.lit(0.0))}, back=1)
    b = stage(b, "differences")
    b = I.invert_difference(b, HOUR, "d", "anchor", "diff", "from_diff")
    b = I.invert_difference(b, HOUR, "l", "anchor", "log_diff", "from_log")
    return b.select("id", "t", rnd("from_diff", 4).alias("from_diff"), rnd("from_log", 4).alias("from_log"))


@query("direction", time="t", sql=f"""with {SQL_DAY},
d as (select id, t, cast(sign(close - lag(close) {W}) as integer) direction from bars_day)
select * from d where direction is not null""")
def direction(spark, sf):
    return I.direction(bars_day(spark, sf), DAY, "close").select("id", "t", "direction")


@query("cumulative_return", time="t", sql=f"""with {SQL_HOUR},
r as (select id, t, coalesce(close / nullif(lag(close) {W}, 0) - 1, 0) / 100 r from bars_hour)
select id, t, round(sum(ln(1 + r)) over (partition by id order by t rows unbounded preceding), 6) + 0.0
  log_growth from r""")
def cumulative_return(spark, sf):
    """Growth of one unit, reported as its logarithm."""
    out = rolled(bars_hour(spark, sf), HOUR,
                 lambda w: {"r": I.daily_return("close", w) / 10000}, back=1)
    out = I.cum_return(stage(out, "returns"), HOUR, "r")
    return out.select("id", "t", rnd(F.ln("cum_return")).alias("log_growth"))


@query("normalise_first", time="t", sql=f"""with {SQL_DAY}
select id, t, round(close / first_value(close) over (partition by id order by t), 6) rebased
from bars_day""")
def normalise_first(spark, sf):
    return I.normalise_first(bars_day(spark, sf), DAY, "close", "rebased").select(
        "id", "t", rnd("rebased").alias("rebased"))


@query("first_dates", time="first_t", sql="""with f as (
  select cast(l_suppkey as varchar) id, min(cast(l_shipdate as date)) first_t from lineitem group by 1)
select id, first_t, year(first_t) as year from f""")
def first_dates(spark, sf):
    return I.first_dates(_ship(spark, sf), DAY)


@query("late_starters", time="first_t", sql="""with f as (
  select cast(l_suppkey as varchar) id, min(cast(l_shipdate as date)) first_t from lineitem group by 1)
select year(first_t) as year, id, first_t, count(*) over (partition by year(first_t)) n_in_year
from f where first_t > date '1995-01-05'""")
def late_starters(spark, sf):
    return I.late_starters(_ship(spark, sf), DAY, dt.date(1995, 1, 5)).select("year", "id", "first_t", "n_in_year")


def _ship(spark, sf):
    from panelspark.catalog.inputs import table
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("id"), F.to_date("l_shipdate").alias("t"))


LAGS = [1, 5, 21, 252]


@query("autocorrelation", f"""with {SQL_DAY},
v as (select id, t, ln(close) - lag(ln(close)) {W} ret from bars_day),
x as (select id, ret, row_number() {W} rn from v where ret is not null),
m as (select id, avg(ret) m, count(*) n, sum(ret * ret) - count(*) * avg(ret) * avg(ret) ss from x group by 1),
l as (select unnest([{", ".join(map(str, LAGS))}]) as lag)
select a.id, l.lag, m.n, round(sum((a.ret - m.m) * (b.ret - m.m)) / m.ss, 6) + 0.0 acf,
  round(1.96 / sqrt(m.n), 6) band
from x a join m on m.id = a.id cross join l join x b on b.id = a.id and b.rn = a.rn - l.lag
group by a.id, l.lag, m.n, m.ss""")
def autocorrelation(spark, sf):
    r = rolled(bars_day(spark, sf), DAY,
               lambda w: {"ret": F.ln("close") - F.ln(I.lag1("close", w))}, back=1)
    return I.acf(r, DAY, "ret", LAGS).select("id", "lag", "n", rnd("acf").alias("acf"),
                                             rnd("band").alias("band"))
