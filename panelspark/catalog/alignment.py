"""Calendars, fills, joins on time, selection and housekeeping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelspark.catalog import query
from panelspark.catalog.inputs import (
    DAY, HOUR, SQL_DAY, SQL_HOUR, SQL_SCORED, bars_day, bars_hour, rnd, scored, table)
from panelspark.functions.calendar import month_table
from panelspark.operators import align as A
from panelspark.operators import calendar as C
from panelspark.sources.bars import parse_vector
from panelspark.sources.sinks import pending

W = "over (partition by id order by t)"
GRID_SQL = f"""{SQL_DAY},
span as (select min(t) lo, max(t) hi from bars_day),
ids as (select distinct id from bars_day),
grid as (select id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) t from ids, span),
full_ as (select grid.id, grid.t, b.open, b.high, b.low, b.close
          from grid left join bars_day b on b.id = grid.id and b.t = grid.t)"""


def _grid(spark, sf):
    """Daily bars on every day of the span, with holes."""
    b = bars_day(spark, sf)
    return C.series_days(b, DAY).join(b, ["id", "t"], "left")


@query("calendar_days", time="t", sql="""with s as (select min(cast(o_orderdate as date)) lo, max(cast(o_orderdate as date)) hi from orders)
select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) t from s""")
def calendar_days(spark, sf):
    return C.days_between(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("t")), "t")


@query("calendar_months", time="month_start month_end", sql="""with m as (select distinct date_trunc('month', o_orderdate) m from orders)
select cast(m as date) month_start, last_day(cast(m as date)) month_end, count(*) n_orders
from m join orders on date_trunc('month', o_orderdate) = m group by 1, 2""")
def calendar_months(spark, sf):
    months = month_table(spark, dt.date(1990, 1, 1), dt.date(2010, 12, 31))
    o = (table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month_start"))
         .agg(F.count(F.lit(1)).alias("n_orders")))
    return months.join(o, "month_start")


NEWS_SQL = """news as (select vec_id, date '1998-01-01' + cast((vec_id * vec_id % 61) * 3 as int) t,
  case when vec_id % 5 = 0 then null else abs(embedding[1]) end prob_positive from embeddings)"""


def _news(spark, sf):
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.expr("date_add(date'1998-01-01', cast((vec_id * vec_id % 61) * 3 as int))").alias("t"),
        F.when(v % 5 != 0, F.abs(F.get("embedding", F.lit(0)))).alias("prob_positive"))


@query("shared_calendar", time="t", sql=f"""with {SQL_DAY}, {NEWS_SQL},
tr as (select distinct t from bars_day where id = '1-URGENT'),
sp as (select min(t) lo, max(t) hi from tr),
al as (select t from tr union select t from news, sp where prob_positive is not null and t between lo and hi)
select t from al where t < date '1998-05-01'""")
def shared_calendar(spark, sf):
    target = bars_day(spark, sf).filter(F.col("id") == "1-URGENT")
    return C.shared_calendar(target, _news(spark, sf), cutoff=dt.date(1998, 5, 1))


@query("reindex_interpolate", time="t", sql=f"""with {GRID_SQL},
cal as (select distinct t from bars_day where id in ('1-URGENT', '5-LOW')),
x as (select f.id, f.t, f.close from full_ f join cal using (t)),
p as (select *, last_value(case when close is not null then t end ignore nulls) over b tp,
  last_value(close ignore nulls) over b vp,
  first_value(case when close is not null then t end ignore nulls) over n tn,
  first_value(close ignore nulls) over n vn from x
  window b as (partition by id order by t rows between unbounded preceding and current row),
         n as (partition by id order by t rows between current row and unbounded following))
select id, t, round(coalesce(close, vp + (vn - vp) * ((t - tp) / nullif(tn - tp, 0)), vp, vn), 7) as close from p""")
def reindex_interpolate(spark, sf):
    """Two markets' calendar for all series: rows on other dates never become anchors."""
    b = bars_day(spark, sf).select("id", "t", "close")
    cal = b.filter(F.col("id").isin("1-URGENT", "5-LOW")).select("t").distinct()
    out = C.interpolate_time(A.reindex(b, DAY, cal), DAY, ["close"])
    return out.select("id", "t", rnd("close", 7).alias("close"))


@query("reindex_hourly", time="t", sql=f"""with {SQL_HOUR},
cal as (select distinct t from bars_hour where hour(t) % 3 <> 1), ids as (select distinct id from bars_hour),
grid as (select id, t from ids, cal)
select g.id, g.t, round(b.close, 6) as close from grid g left join (select * from bars_hour where hour(t) % 7 <> 2) b using (id, t)""")
def reindex_hourly(spark, sf):
    """An hourly calendar with holes, for hourly series with other holes."""
    b = bars_hour(spark, sf).select("id", "t", "close")
    out = A.reindex(b.filter("hour(t) % 7 <> 2"), HOUR, b.filter("hour(t) % 3 <> 1").select("t"))
    return out.select("id", "t", rnd("close").alias("close"))


@query("ffill_bfill", time="t", sql=f"""with {GRID_SQL}
select id, t, round(coalesce(
  last_value(close ignore nulls) over (partition by id order by t rows between unbounded preceding and current row),
  first_value(close ignore nulls) over (partition by id order by t rows between current row and unbounded following)), 4) as close,
  round(coalesce(
  last_value(low ignore nulls) over (partition by id order by t rows between unbounded preceding and current row),
  first_value(low ignore nulls) over (partition by id order by t rows between current row and unbounded following)), 4) as low
from full_""")
def ffill_bfill(spark, sf):
    out = C.ffill_bfill(_grid(spark, sf), DAY, ["close", "low"])
    return out.select("id", "t", rnd("close", 4).alias("close"), rnd("low", 4).alias("low"))


@query("date_gaps", time="t prev_t", sql=f"""with {SQL_DAY}, g as (select id, t, lag(t) {W} prev_t from bars_day)
select id, t, prev_t, cast(t - prev_t as integer) gap_days from g where t - prev_t > 1""")
def date_gaps(spark, sf):
    return C.date_gaps(bars_day(spark, sf), DAY, 1).select("id", "t", "prev_t", "gap_days")


COVER_SQL = f"""{SQL_DAY}, span as (select min(t) lo, max(t) + 5 hi from bars_day),
days as (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) t from span),
cov as (select days.t, case when b.t is null then 0 else 1 end flag from days
  left join (select t from bars_day where id = '3-MEDIUM') b using (t))"""


def _cover(spark, sf):
    b = bars_day(spark, sf)
    days = C.days_between(b, "t", end=F.date_add(F.max("t"), 5))
    one = b.filter(F.col("id") == "3-MEDIUM").select("t", F.lit(1).alias("flag"))
    return days.join(one, "t", "left").withColumn("flag", F.coalesce("flag", F.lit(0)))


@query("coverage_gaps", time="t last_covered", sql=f"""with {COVER_SQL}, l as (select max(t) last_covered from cov where flag > 0)
select t, last_covered, case when t > last_covered then 'trailing' else 'isolated' end kind
from cov, l where flag = 0""")
def coverage_gaps(spark, sf):
    return C.coverage_gaps(_cover(spark, sf), "t", "flag").select("t", "last_covered", "kind")


@query("empty_runs", time="first_t last_t", sql=f"""with {COVER_SQL},
r as (select t, flag, sum(flag) over (order by t rows unbounded preceding) run from cov)
select min(t) first_t, max(t) last_t, count(*) n_rows from r where flag = 0 group by run""")
def empty_runs(spark, sf):
    out = C.empty_runs(_cover(spark, sf).withColumn("id", F.lit("market")), DAY, "flag")
    return out.select("first_t", "last_t", "n_rows")


@query("trading_day_mask", time="t", sql=f"""with {GRID_SQL}
select id, t, case when close is not null then 1 else 0 end trading_day from full_""")
def trading_day(spark, sf):
    return C.trading_day(_grid(spark, sf)).select("id", "t", "trading_day")


@query("fill_isolated_news", time="date", sql=f"""with {SQL_SCORED},
d as (select date, avg(prob_positive) p, avg(prob_negative) n, avg(prob_neutral) u, avg(embedding[1]) e1, avg(embedding[64]) e64
      from scored group by 1),
h as (select a.date + 1 date, (a.p + b.p) / 2 p, (a.n + b.n) / 2 n, (a.u + b.u) / 2 u, (a.e1 + b.e1) / 2 e1, (a.e64 + b.e64) / 2 e64
      from d a join d b on b.date = a.date + 2 where a.date + 1 not in (select date from d)),
x as (select *, 0 filled from d union all select *, 1 filled from h)
select date, round(p, 6) prob_positive, round(n, 6) prob_negative, round(u, 6) prob_neutral,
  round(e1, 6) + 0.0 e1, round(e64, 6) + 0.0 e64, filled,
  case when p >= n and p >= u then 'positive' when n >= u then 'negative' else 'neutral' end as label from x""")
def fill_isolated_news(spark, sf):
    from panelspark.operators.news import daily_news
    daily = daily_news(scored(spark, sf), "date")
    out = C.fill_isolated(daily, "date")
    out = out.join(daily.select("date", F.lit(0).alias("filled")), "date", "left")
    return out.select("date", *[rnd(c).alias(c) for c in C.PROB_COLS],
                      rnd(F.get("embedding", F.lit(0))).alias("e1"),
                      rnd(F.get("embedding", F.lit(63))).alias("e64"),
                      F.coalesce("filled", F.lit(1)).alias("filled"), "label")


@query("fill_isolated_probs_only", time="date", sql=f"""with {SQL_SCORED},
d as (select date, avg(prob_positive) p, avg(prob_negative) n, avg(prob_neutral) u, count(*) c from scored group by 1),
h as (select a.date + 1 date, (a.p + b.p) / 2 p, (a.n + b.n) / 2 n, (a.u + b.u) / 2 u, null c
      from d a join d b on b.date = a.date + 2 where a.date + 1 not in (select date from d)),
x as (select * from d union all select * from h)
select date, round(p, 6) prob_positive, round(n, 6) prob_negative, round(u, 6) prob_neutral,
  coalesce(c, -1) n_articles from x""")
def fill_isolated_probs_only(spark, sf):
    """News without vectors; a column of its own is kept and null on added days."""
    daily = scored(spark, sf).groupBy("date").agg(*[F.avg(c).alias(c) for c in C.PROB_COLS],
                                                  F.count(F.lit(1)).alias("n_articles"))
    out = C.fill_isolated(daily.withColumn("label", F.lit(None).cast("string")), "date")
    return out.select("date", *[rnd(c).alias(c) for c in C.PROB_COLS],
                      F.coalesce("n_articles", F.lit(-1)).alias("n_articles"))


@query("dense_vectors", time="date", sql=f"""with {SQL_SCORED}, e as (select date, min(vec_id) vec_id from scored group by 1),
c as (select cast(unnest(generate_series(date '2024-01-01', date '2024-03-01', interval 1 day)) as date) date),
v as (select c.date, s.embedding from c left join e using (date) left join scored s on s.vec_id = e.vec_id)
select date, case when embedding is null then 64 else len(embedding) end dim,
  round(case when embedding is null then 0 else list_sum(list_transform(embedding, lambda x: cast(x as double) * x)) end, 6) sq from v""")
def dense_vectors(spark, sf):
    s = scored(spark, sf)
    one = s.groupBy("date").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    cal = C.calendar(spark, dt.date(2024, 1, 1), dt.date(2024, 3, 1), "date")
    out = C.dense_vectors(cal.join(one, "date", "left"), "embedding")
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("date", F.size("embedding").alias("dim"), rnd(sq).alias("sq"))


@query("zero_vectors", time="t", sql="""select cast(o_orderdate as date) t, 768 dim, cast(0 as double) total, count(*) n from orders group by 1""")
def zero_vectors(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("t")).agg(
        F.count(F.lit(1)).alias("n"))
    out = C.zero_vectors(o, 768)
    return out.select("t", F.size("embedding").alias("dim"),
                      F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"), "n")


@query("select_features", time="t", sql=f"""with {SQL_DAY}
select t, round(max(case when id = '5-LOW' then close end), 4) low_close,
  round(max(case when id = '5-LOW' then high end), 4) low_high,
  round(max(case when id = '2-HIGH' then open end), 4) high_open
from bars_day where id in ('5-LOW', '2-HIGH') group by t""")
def select_features(spark, sf):
    out = A.select_features(bars_day(spark, sf), [("5-LOW", ["close", "high"]), ("2-HIGH", ["open"])])
    names = {"5-LOW_close": "low_close", "5-LOW_high": "low_high", "2-HIGH_open": "high_open"}
    return out.select("t", *[rnd(F.col(f"`{a}`"), 4).alias(b) for a, b in names.items()])


@query("feature_names", """select distinct regexp_replace(p, '^\\^', '') || '_' || f feature from (
  select unnest(['^' || o_orderstatus, o_orderpriority]) p, unnest(['close', 'RSI']) f from orders) x""")
def feature_names(spark, sf):
    o = table(spark, sf, "orders").select(F.explode(F.array(
        F.struct(F.concat(F.lit("^"), "o_orderstatus").alias("p"), F.lit("Close").alias("f")),
        F.struct(F.col("o_orderpriority").alias("p"), F.lit("RSI").alias("f")))).alias("x"))
    o = o.select("x.*").distinct()
    return o.select(A.feature_name("p", "f").alias("feature"))


IDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("align_outer_wide", time="t", sql=f"""with {SQL_DAY}
select t, {", ".join(f"round(max(case when id = '{i}' then close end), 4) s{i[0]}" for i in IDS)}
from bars_day group by t""")
def align_outer_wide(spark, sf):
    out = A.align_outer(bars_day(spark, sf), IDS)
    return out.select("t", *[rnd(F.col(f"`{i}`"), 4).alias(f"s{i[0]}") for i in IDS])


@query("long_features", time="t", sql=f"""with {SQL_DAY}
select id, t, feature, round(value, 4) as value from bars_day unpivot (value for feature in (open, high, low, close))""")
def long_features(spark, sf):
    out = A.to_long(bars_day(spark, sf), DAY, ["open", "high", "low", "close"])
    return out.select("id", "t", "feature", rnd("value", 4).alias("value"))


SIDES_SQL = f"""{SQL_DAY}, a as (select t, close as a_close from bars_day where id = '1-URGENT'),
b as (select t, close as b_close from bars_day where id = '5-LOW'),
f as (select t, close as f_close from bars_day where id = '3-MEDIUM')"""


def _side(b, i, name):
    return b.filter(F.col("id") == i).select("t", F.col("close").alias(name))


def _sides(spark, sf):
    b = bars_day(spark, sf)
    return _side(b, "1-URGENT", "a_close"), _side(b, "5-LOW", "b_close"), _side(b, "3-MEDIUM", "f_close")


@query("concat_panels", time="t", sql=f"""with {SIDES_SQL}
select t, round(a_close, 4) a_close, round(b_close, 4) b_close from a full outer join b using (t)""")
def concat_panels(spark, sf):
    a, b, _ = _sides(spark, sf)
    return A.concat_panels(a, b).select("t", rnd("a_close", 4).alias("a_close"),
                                        rnd("b_close", 4).alias("b_close"))


@query("common_dates", time="t", sql=f"""with {SIDES_SQL}
select t, round(a_close, 4) a_close, round(b_close, 4) b_close from a join b using (t)""")
def common_dates(spark, sf):
    a, b, _ = _sides(spark, sf)
    return A.common_dates(a, b).select("t", rnd("a_close", 4).alias("a_close"),
                                       rnd("b_close", 4).alias("b_close"))


@query("common_trading_days", time="t", sql=f"""with {SIDES_SQL}
select t, round(a_close - b_close, 4) + 0.0 spread from a join b using (t) join f using (t)""")
def common_trading_days(spark, sf):
    a, b, f = _sides(spark, sf)
    out = A.common_trading(a, b, C.trading_day(f, "f_close"))
    return out.select("t", rnd(F.col("a_close") - F.col("b_close"), 4).alias("spread"))


@query("count_between", time="t", sql="""with sp as (select distinct cast(l_suppkey % 3 as bigint) id, cast(l_shipdate as date) t
  from lineitem where day(l_shipdate) in (1, 8, 20)),
pt as (select o_custkey % 3 id, cast(o_orderdate as date) t from orders),
nx as (select id, t, lead(t) over (partition by id order by t) nt from sp)
select nx.id, nx.t, count(pt.t) n_points from nx left join pt on pt.id = nx.id and pt.t >= nx.t
  and (nx.nt is null or pt.t < nx.nt) group by 1, 2""")
def count_between(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).alias("id"),
                                             F.to_date("l_shipdate").alias("t"))
    spans = li.filter(F.dayofmonth("t").isin(1, 8, 20)).distinct()
    points = table(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("id"),
                                               F.to_date("o_orderdate").alias("t"))
    return A.count_between(points, spans, DAY)


@query("reconcile_vendor", time="t", sql=f"""with {SQL_DAY},
m(id, vendor_ticker, factor) as (values ('1-URGENT', 'U', 0.0625), ('2-HIGH', 'H', 1.0), ('5-LOW', 'L', 1.0)),
v as (select substr(id, 3, 1) ticker, t, close * case when id = '1-URGENT' then 0.0625 else 1.01 end as close
      from bars_day where day(t) <> 13),
o as (select b.id, t, close * coalesce(factor, 1) ours, vendor_ticker is not null mapped
      from bars_day b left join m using (id) where day(t) <> 7),
j as (select coalesce(o.id, w.id) id, coalesce(o.t, w.t) t, ours, w.close vendor, coalesce(mapped, true) mapped
      from o full outer join (select m.id, v.t, v.close from v join m on v.ticker = m.vendor_ticker) w
      on w.id = o.id and w.t = o.t)
select id, t, round(abs(ours - vendor), 4) abs_dev, round(abs((ours - vendor) / vendor), 6) rel_dev,
  case when ours is null then 'ours' when vendor is null and mapped then 'vendor' end missing,
  coalesce(abs((ours - vendor) / vendor) > 0.005, false) off from j""")
def reconcile_vendor(spark, sf):
    b = bars_day(spark, sf)
    mapping = spark.createDataFrame([("1-URGENT", "U", 0.0625), ("2-HIGH", "H", 1.0), ("5-LOW", "L", 1.0)],
                                    "id string, vendor_ticker string, factor double")
    vendor = b.filter(F.dayofmonth("t") != 13).select(
        F.substring("id", 3, 1).alias("ticker"), "t",
        (F.col("close") * F.when(F.col("id") == "1-URGENT", 0.0625).otherwise(1.01)).alias("close"))
    out = A.reconcile(b.filter(F.dayofmonth("t") != 7), vendor, mapping, tolerance=0.005)
    return out.select("id", "t", rnd("abs_dev", 4).alias("abs_dev"), rnd("rel_dev").alias("rel_dev"),
                      "missing", "off")


@query("row_differences", """with a as (select l_orderkey k, l_linenumber n from lineitem where l_quantity < 40),
b as (select l_orderkey k, l_linenumber n from lineitem where l_quantity > 10)
select *, 'only_a' side from (select * from a except all select * from b)
union all select *, 'only_b' side from (select * from b except all select * from a)""")
def row_differences(spark, sf):
    li = table(spark, sf, "lineitem")
    pick = [F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")]
    return A.row_diff(li.filter("l_quantity < 40").select(*pick), li.filter("l_quantity > 10").select(*pick))


FIRST_SQL = """s as (select l_suppkey id, cast(l_shipdate as date) t, l_orderkey k, l_linenumber n from lineitem),
f as (select id, min(t) first_t from s group by 1)"""


def _supply(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("t"),
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))


@query("min_history", time="t", sql=f"""with {FIRST_SQL}
select s.* from s join f using (id) where first_t <= date '1995-01-05'""")
def min_history(spark, sf):
    return A.min_history(_supply(spark, sf), DAY, dt.date(1995, 1, 5))


@query("short_history", time="first_t", sql=f"""with {FIRST_SQL} select id, first_t from f where first_t > date '1995-01-05'""")
def short_history(spark, sf):
    return A.short_history(_supply(spark, sf), DAY, dt.date(1995, 1, 5))


@query("cutoff", time="t", sql=f"""with {SQL_DAY} select id, t, round(close, 4) as close from bars_day where t < date '1996-07-01'""")
def cutoff(spark, sf):
    return A.cutoff(bars_day(spark, sf), "t", dt.date(1996, 7, 1)).select(
        "id", "t", rnd("close", 4).alias("close"))


@query("drop_incomplete", time="t", sql=f"""with {GRID_SQL} select id, t, round(close, 4) as close from full_
where open is not null and high is not null and low is not null and close is not null""")
def drop_incomplete(spark, sf):
    return _grid(spark, sf).dropna("any").select("id", "t", rnd("close", 4).alias("close"))


@query("unit_conversion", time="t", sql=f"""with {SQL_DAY}
select id, t, round(close / case when id in ('1-URGENT', '2-HIGH') then 16 else 1 end, 6) as close
from bars_day where low > 2000""")
def unit_conversion(spark, sf):
    factors = spark.createDataFrame([("1-URGENT", 1 / 16), ("2-HIGH", 1 / 16)], "id string, factor double")
    out = A.to_unit(A.positive_only(bars_day(spark, sf).withColumn("low", F.col("low") - 2000), "low"), factors)
    return out.select("id", "t", rnd("close").alias("close"))


@query("suspicious_rows", time="t", sql="""with b as (select l_suppkey id, cast(l_shipdate as date) t, l_linenumber n, l_orderkey k,
  l_extendedprice - 2000 p, l_discount v from lineitem)
select id, t, n, k, isodow(t) >= 6 weekend, p <= 0 bad_price, v = 0 zero_volume from b
where isodow(t) >= 6 or p <= 0 or v = 0""")
def suspicious_rows(spark, sf):

    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("t"),
        F.col("l_linenumber").alias("n"), F.col("l_orderkey").alias("k"),
        (F.col("l_extendedprice") - 2000).alias("p"), F.col("l_discount").alias("v"))
    return A.suspicious_rows(li, prices=("p",), volume="v").drop("p", "v")


@query("parse_vector", """select vec_id, len(embedding) dim, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) + 0.0 total from embeddings""")
def parse_vector_query(spark, sf):
    """Vectors written as list text and read back."""
    e = table(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("text"))
    e = e.withColumn("v", parse_vector("text"))
    return e.select("vec_id", F.size("v").alias("dim"),
                    rnd(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("dedupe_last", time="t", sql="""select cast(o_orderdate as date) t, o_orderpriority id, arg_max(o_totalprice, o_orderkey) price,
  max(o_orderkey) k from orders group by 1, 2""")
def dedupe_last(spark, sf):
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("t"), F.col("o_orderpriority").alias("id"),
                                          F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("k"))
    return A.dedupe_last(o, ["t", "id"], ["k"])


@query("duplicate_rows", """select l_orderkey k, l_linenumber n, l_partkey p, count(*) over (partition by l_orderkey, l_linenumber) n_rows
from lineitem qualify n_rows > 1""")
def duplicate_rows(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
                                             F.col("l_partkey").alias("p"))
    return A.duplicates(li, ["k", "n"])


@query("union_series", time="t", sql=f"""with {SQL_DAY}, {SQL_HOUR.replace("bars_hour", "h", 1)}
select id, cast(t as date) t, round(close, 4) as close from bars_day union all
select id, cast(t as date) t, round(close, 4) as close from h""")
def union_series(spark, sf):
    parts = [b.select("id", F.to_date("t").alias("t"), rnd("close", 4).alias("close"))
             for b in (bars_day(spark, sf), bars_hour(spark, sf))]
    return A.union_series(*parts)


@query("pending_units", time="t", sql="""select distinct cast(o_orderdate as date) t from orders
where cast(o_orderdate as date) not in (select cast(l_shipdate as date) from lineitem where l_quantity >= 45)""")
def pending_units(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("t")).distinct()
    done = table(spark, sf, "lineitem").filter("l_quantity >= 45").select(F.to_date("l_shipdate").alias("t"))
    return pending(days, done, ["t"])


@query("sanitize_names", r"""select distinct regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') as name from pages""")
def sanitize_names(spark, sf):
    return table(spark, sf, "pages").select(A.sanitize("url").alias("name")).distinct()


@query("read_panel_projection", time="date", sql="""select o_orderdate as date, o_orderpriority id, o_totalprice from orders
where o_orderpriority in ('1-URGENT', '5-LOW')""")
def read_panel_projection(spark, sf):
    from panelspark.sources.bars import read_panel
    out = read_panel(spark, f"{sf}/orders.parquet", ["1-URGENT", "5-LOW"], ["o_totalprice"],
                     key="o_orderpriority", t="o_orderdate")
    return out.select(F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("id"), "o_totalprice")
