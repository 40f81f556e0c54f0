"""Rule tables over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog import query
from panelspark.catalog.alignment import GRID_SQL, _grid
from panelspark.catalog.indicators import ENRICH_SQL
from panelspark.catalog.inputs import HOUR, SQL_DAY, SQL_HOUR, SQL_SCORED, bars_day, bars_hour, rnd, scored, table
from panelspark.operators import calendar as C
from panelspark.operators import indicators as I
from panelspark.operators import quality as Q
from panelspark.session import stage

COLS = ["case", "rule", "severity", "ok", "n_bad", "n"]


def rule(case: str, name: str, severity: str, bad: str, n: str, src: str) -> str:
    return f"""select '{case}' as "case", '{name}' as rule, '{severity}' severity, {bad} = 0 ok, cast({bad} as bigint) n_bad, cast({n} as bigint) n from {src}"""


def cnt(cond: str) -> str:
    return f"count(*) filter ({cond})"


@query("quality_line_items", " union all ".join([
    rule("items", "no_null:l_shipdate", "FAIL", cnt("l_shipdate is null"), "count(*)", "lineitem"),
    rule("items", "range:l_discount", "FAIL", cnt("l_discount not between 0 and 0.05"), "count(l_discount)", "lineitem"),
    rule("items", "positive:l_quantity", "FAIL", cnt("l_quantity <= 0"), "count(l_quantity)", "lineitem"),
    rule("items", "no_inf:l_tax", "FAIL", cnt("isinf(l_tax) or isnan(l_tax)"), "count(*)", "lineitem"),
    rule("items", "flag_01:l_linenumber", "WARN", cnt("l_linenumber not in (0, 1)"), "count(*)", "lineitem"),
    rule("items", "not_constant:l_tax", "WARN", "cast(stddev_samp(l_tax) <= 1e-8 as int)", "count(*)", "lineitem")]))
def quality_line_items(spark, sf):
    rules = [Q.no_null("l_shipdate"), Q.in_range("l_discount", 0, 0.05), Q.positive("l_quantity"),
             Q.no_inf("l_tax"), Q.flag_01("l_linenumber", Q.WARN), Q.not_constant("l_tax")]
    return Q.check(table(spark, sf, "lineitem"), rules, "items")


RANGES = {"RSI": (0, 100), "Stoch_K": (0, 100), "Stoch_D": (0, 100), "Williams_R": (-100, 0), "Movement": (-1, 1),
          **{f"{f}_{p}": (-1, 1) for f in ("sin", "cos") for p in ("dow", "month", "doy")}}


@query("quality_indicator_ranges", f"with {SQL_HOUR}, base as (select * from bars_hour), {ENRICH_SQL} " + " union all ".join(
    rule("hourly", f"range:{c}", "FAIL", cnt(f"{c} not between {lo - 1e-9 if lo else -1e-9} and {hi + 1e-9}"), f"count({c})", "c")
    for c, (lo, hi) in RANGES.items()))
def quality_indicator_ranges(spark, sf):
    out = I.enrich(bars_hour(spark, sf), HOUR, drop_nulls=False)
    rules = [Q.in_range(c, lo - 1e-9, hi + 1e-9) for c, (lo, hi) in RANGES.items()]
    return Q.check(out, rules, "hourly")


@query("quality_nulls_by_mask", f"with {GRID_SQL}, m as (select *, case when close is not null then 1 else 0 end flag from full_) " + " union all ".join(
    [rule("panel", f"null_only_where_closed:{c}", "FAIL", cnt(f"{c} is null and flag = 1"), "count(*)", "m") for c in ("open", "high", "close")]
    + [rule("panel", "flag_01:odd_flag", "FAIL", cnt("flag + dayofmonth(t) % 2 > 1"), "count(*)", "m")]))
def quality_nulls_by_mask(spark, sf):
    g = C.trading_day(_grid(spark, sf))
    closed = F.col("trading_day") == 0
    rules = [Q.null_only_where(c, closed, "closed") for c in ("open", "high", "close")] + [Q.flag_01("odd_flag")]
    g = g.withColumn("odd_flag", F.col("trading_day") + F.dayofmonth("t") % 2)  # 2 on some days
    return Q.check(g, rules, "panel")




@query("quality_news", f"with {SQL_SCORED} " + " union all ".join([
    rule("news", "range:prob_positive", "FAIL", cnt("prob_positive not between 0 and 1"), "count(prob_positive)", "scored"),
    rule("news", "label_iff_prob:label", "FAIL", cnt("vec_id % 7 = 0"), "count(*)", "scored"),
    rule("news", "label_domain:label", "FAIL", cnt("vec_id % 7 <> 0 and vec_id % 11 = 0"), cnt("vec_id % 7 <> 0"), "scored"),
    rule("news", "embedding_present:embedding", "FAIL", cnt("embedding is null"), "count(*)", "scored"),
    rule("news", "embedding_dim:embedding", "FAIL", cnt("len(embedding) <> 64"), "count(embedding)", "scored"),
    rule("news", "embedding_finite:odd_vector", "FAIL", cnt("vec_id % 13 in (0, 1, 2)"), "count(embedding)", "scored"),
    rule("news", "embedding_norm:embedding", "WARN", cnt("sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) <= 1.2"), "count(embedding)", "scored")]))
def quality_news(spark, sf):
    s = scored(spark, sf)
    label = C.first_max_label([F.col(c) for c in C.PROB_COLS])
    odd = F.when(F.expr("vec_id % 13 = 0"), F.lit(float("inf"))).when(F.expr("vec_id % 13 = 1"), F.lit(float("nan")))
    s = s.withColumns({  # rows that break each rule
        "label": F.when(F.expr("vec_id % 7 <> 0"), F.when(F.expr("vec_id % 11 = 0"), "mixed").otherwise(label)),
        "odd_vector": F.when(F.expr("vec_id % 13 < 3"), F.array_append(F.col("embedding").cast("array<double>"), odd))
        .otherwise(F.col("embedding").cast("array<double>"))})
    rules = [Q.in_range("prob_positive", 0, 1), Q.label_iff_prob(), Q.label_domain(),
             Q.embedding_present("embedding", F.col("label").isNotNull()), Q.embedding_dim("embedding", 64),
             Q.embedding_finite("odd_vector"), Q.embedding_norm("embedding", 1.2)]
    return Q.check(s, rules, "news")


@query("quality_relations", f"""with {SQL_DAY}, a as (select id, t, close from bars_day), b as (select id, t, close + case when day(t) = 5 then 1 else 0 end as close from bars_day where day(t) <> 9),
u as (select id, t, count(*) n from (select o_orderpriority id, cast(o_orderdate as date) t from orders) group by 1, 2),
k as (select o_orderstatus s, o_orderkey q, o_orderdate t, lag(o_orderdate) over (partition by o_orderstatus order by o_orderkey) p from orders)
select 'x' as "case", 'same_row_counts:a,b' as rule, 'FAIL' severity, false ok, (select count(*) from a) - (select count(*) from b) n_bad, (select count(*) from a) n union all
select 'x', 'same_keys:id,t', 'FAIL', false, (select count(*) from a where day(t) = 9), (select count(*) from a) union all
select 'x', 'unique:id,t', 'FAIL', (select sum(n - 1) from u) = 0, cast((select sum(n - 1) from u) as bigint), (select count(*) from u) union all
select 'x', 'monotonic:t', 'FAIL', (select count(*) from k where p > t) = 0, (select count(*) from k where p > t), (select count(*) from k) union all
select 'x', 'same_values:close', 'FAIL', false, (select count(*) from b where day(t) = 5), (select count(*) from b)""")
def quality_relations(spark, sf):
    a = stage(bars_day(spark, sf).select("id", "t", "close"), "bars")
    b = a.filter(F.dayofmonth("t") != 9).withColumn(
        "close", F.col("close") + F.when(F.dayofmonth("t") == 5, 1).otherwise(0))
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("id"), F.to_date("o_orderdate").alias("t"),
                                          F.col("o_orderkey").alias("q"), F.col("o_orderstatus").alias("s"))
    parts = [Q.same_row_counts({"a": a, "b": b}, "x"), Q.same_keys(a, b, ["id", "t"], "x"),
             Q.unique_keys(o, ["id", "t"], "x"), Q.monotonic(o, ["s"], "q", "t", "x"),
             Q.same_values(a, b, ["id", "t"], "close", "x")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("quality_schema", "with days as (select distinct cast(o_orderdate as date) t from orders) " + " union all ".join([
    *(rule("features", f"has_column:{c}", "FAIL", "0", "1", "(select 1)") for c in ("t", "sin_dow", "cos_doy")),
    rule("features", "has_column:sin_year", "FAIL", "1", "1", "(select 1)"),
    rule("features", "lacks_column:trading_day", "FAIL", "0", "1", "(select 1)"),
    rule("features", "lacks_column:day_close", "FAIL", "1", "1", "(select 1)"),
    rule("features", "no_price_derived_columns", "FAIL", "1", "8", "(select 1)"),
    rule("features", "no_null:t", "FAIL", cnt("t is null"), "count(*)", "days")]))
def quality_schema(spark, sf):
    """Required, forbidden and price-derived columns of the calendar features of real days; a column
    misses and one is derived from prices."""
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("t")).distinct()
    feats = days.withColumns(I.calendar_features("t")).withColumn("day_close", F.lit(0.0))
    return Q.schema_checks(spark, feats, "features", ["t", "sin_dow", "cos_doy", "sin_year"],
                           ["trading_day", "day_close"], True).unionByName(
        Q.check(feats, [Q.no_null("t")], "features"))


@query("quality_issues", """select 'items' as "case", 'range:l_discount' as rule, 'FAIL' severity, count(*) filter (l_discount > 0.05) n_bad from lineitem
union all select 'items', 'positive:l_tax', 'WARN', count(*) filter (l_tax <= 0) from lineitem""")
def quality_issues(spark, sf):
    rules = [Q.positive("l_tax", Q.WARN), Q.in_range("l_discount", 0, 0.05), Q.no_null("l_tax")]
    out = Q.issues(Q.check(table(spark, sf, "lineitem"), rules, "items"))
    return out.select("case", "rule", "severity", "n_bad")


@query("missing_report", f"""with {GRID_SQL}
select 'close' as "column", count(*) filter (close is null) n_null, 0 n_not_finite, count(*) n, round(count(*) filter (close is null) * 100.0 / count(*), 6) null_pct from full_
union all select 'id', 0, 0, count(*), 0.0 from full_""")
def missing_report(spark, sf):
    out = Q.missing_report(_grid(spark, sf).select("id", "close"))
    return out.select("column", "n_null", "n_not_finite", "n", rnd("null_pct").alias("null_pct"))


@query("spike_detection", time="t", sql=f"""with {SQL_HOUR},
l as (select id, t, close, list(close) over (partition by id order by t rows between 29 preceding and current row) f from bars_hour),
m as (select *, list_aggregate(f, 'median') median from l where len(f) = 30),
d as (select *, list_aggregate(list_transform(f, lambda v: abs(v - median)), 'median') mad from m)
select id, t, round(median, 6) median, round(mad, 6) mad, round(0.6745 * (close - median) / mad, 4) robust_z from d
where mad > 0 and abs(0.6745 * (close - median) / mad) > 3""")
def spike_detection(spark, sf):
    out = Q.spikes(bars_hour(spark, sf), HOUR, "close", 30, 3.0)
    return out.select("id", "t", rnd("median").alias("median"), rnd("mad").alias("mad"), rnd("robust_z", 4).alias("robust_z"))
