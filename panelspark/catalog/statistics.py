"""Summaries, association, correlation and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog import query
from panelspark.catalog.inputs import DAY, SQL_DAY, bars_day, rnd, scored, table
from panelspark.operators import align as A
from panelspark.operators import calendar as C
from panelspark.operators import indicators as I
from panelspark.operators import stats as S
from panelspark.operators.segments import rolled
from panelspark.session import stage


def _rounded(df, n=6, keep=()):
    kinds = dict(df.dtypes)
    return df.select(*[rnd(F.col(f"`{c}`"), n).alias(c) if kinds[c] == "double" and c not in keep else F.col(f"`{c}`")
                       for c in df.columns])


@query("describe_series", f"""with {SQL_DAY}
select id, round(min(close), 4) min, round(max(close), 4) max, round(avg(close), 4) mean, count(close) n from bars_day group by 1""")
def describe_series(spark, sf):
    return _rounded(S.describe_series(bars_day(spark, sf), DAY, "close"), 4)


@query("describe_column", """select count(l_extendedprice) n, round(avg(l_extendedprice), 4) mean,
  round(stddev_samp(l_extendedprice), 4) std, min(l_extendedprice) min, max(l_extendedprice) max,
  round(quantile_cont(l_extendedprice, 0.25), 4) q25, round(quantile_cont(l_extendedprice, 0.5), 4) q50,
  round(quantile_cont(l_extendedprice, 0.75), 4) q75 from lineitem""")
def describe_column(spark, sf):
    return _rounded(S.describe(table(spark, sf, "lineitem"), [], "l_extendedprice"), 4)


QUANTILES_SQL = """select l_returnflag flag, q, round(quantile_cont(l_extendedprice, q), 4) as value
from lineitem, (values (0.0::double), (0.05), (0.5), (0.9), (0.999), (1.0)) t(q) group by 1, 2""".replace(
    "quantile_cont(l_extendedprice, q)", """case q when 0.0 then quantile_cont(l_extendedprice, 0.0)
  when 0.05 then quantile_cont(l_extendedprice, 0.05) when 0.5 then quantile_cont(l_extendedprice, 0.5)
  when 0.9 then quantile_cont(l_extendedprice, 0.9) when 0.999 then quantile_cont(l_extendedprice, 0.999)
  else quantile_cont(l_extendedprice, 1.0) end""")


@query("exact_quantiles_by_group", QUANTILES_SQL)
def exact_quantiles_by_group(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    out = S.exact_percentiles(li, ["flag"], "l_extendedprice", [0.0, 0.05, 0.5, 0.9, 0.999, 1.0])
    return out.select("flag", "q", rnd("value", 4).alias("value"))


@query("exact_quantiles_sketch", QUANTILES_SQL)
def exact_quantiles_sketch(spark, sf):
    """The same where a sketch brackets the ranks: it is coarse, so that small tables need it, too."""
    li = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    out = S.exact_percentiles(li, ["flag"], "l_extendedprice", [0.0, 0.05, 0.5, 0.9, 0.999, 1.0], accuracy=1_000)
    return out.select("flag", "q", rnd("value", 4).alias("value"))


@query("value_shares", """with d as (select unnest(['R', 'A', 'N', 'X']) as value), c as (select l_returnflag as value, count(*) n from lineitem group by 1)
select d.value, coalesce(n, 0) n, round(coalesce(n, 0) / cast(sum(coalesce(n, 0)) over () as double), 6) as share from d left join c using (value)""")
def value_shares(spark, sf):
    out = S.value_shares(table(spark, sf, "lineitem"), "l_returnflag", ["R", "A", "N", "X"])
    return out.select("value", "n", rnd("share").alias("share"))


@query("mean_return_by_weekday", f"""with {SQL_DAY}, r as (select id, t, (close / lag(close) over (partition by id order by t) - 1) * 100 ret from bars_day)
select id, cast(isodow(t) - 1 as integer) weekday, round(avg(ret), 6) mean, count(ret) n from r group by 1, 2""")
def mean_return_by_weekday(spark, sf):
    r = rolled(bars_day(spark, sf), DAY, lambda w: {"ret": I.daily_return("close", w)}, back=1)
    return S.mean_by(r, ["id", F.weekday("t").alias("weekday")], "ret").select("id", "weekday", rnd("mean").alias("mean"), "n")


@query("calendar_composition", f"""with {SQL_DAY}, sp as (select min(t) lo, max(t) hi from bars_day),
d as (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) t from sp),
b as (select t from bars_day where id = '3-MEDIUM')
select cast(year(d.t) as integer) as year, count(b.t) trading, count(*) - count(b.t) non_trading from d left join b using (t) group by 1""")
def calendar_composition(spark, sf):
    b = bars_day(spark, sf)
    days = C.days_between(b, "t").join(b.filter("id = '3-MEDIUM'").select("t", "close"), "t", "left")
    return S.calendar_composition(C.trading_day(days))


@query("histogram_density", """with r as (select l_extendedprice x from lineitem), m as (select min(x) lo, max(x) hi, count(*) c from r),
b as (select least(floor((x - lo) / ((hi - lo) / 20)), 19) bin, count(*) n from r, m group by 1)
select g.i bin, coalesce(n, 0) n, round(lo + g.i * (hi - lo) / 20, 4) as left, round(coalesce(n, 0) / (c * (hi - lo) / 20), 9) density
from generate_series(0, 19) g(i) cross join m left join b on b.bin = g.i""")
def histogram_density(spark, sf):
    li = table(spark, sf, "lineitem")
    lo, hi = li.agg(F.min("l_extendedprice")).scalar(), li.agg(F.max("l_extendedprice")).scalar()
    out = S.histogram(li, "l_extendedprice", 20, lo, hi, density=True)
    return out.select("bin", "n", rnd("left", 4).alias("left"), rnd("density", 9).alias("density"))


@query("histogram_clipped", """with r as (select l_extendedprice x from lineitem), m as (select quantile_cont(x, 0.01) lo, quantile_cont(x, 0.99) hi from r),
b as (select least(floor((x - lo) / ((hi - lo) / 40)), 39) bin, count(*) n from r, m where x between lo and hi group by 1)
select g.i bin, coalesce(n, 0) n, round(lo + g.i * (hi - lo) / 40, 2) as left from generate_series(0, 39) g(i) cross join m left join b on b.bin = g.i""")
def histogram_clipped(spark, sf):
    li = table(spark, sf, "lineitem")
    lo, hi = S.clipped_range(li, "l_extendedprice", 0.01, 0.99)
    return S.histogram(li, "l_extendedprice", 40, lo, hi).select("bin", "n", rnd("left", 2).alias("left"))


@query("year_histogram", """select cast(y as integer) as year, count(o_orderkey) n from generate_series(1990, 2010) g(y)
left join orders on year(o_orderdate) = y group by 1""")
def year_histogram(spark, sf):
    return S.year_histogram(table(spark, sf, "orders"), "o_orderdate", 1990, 2010)


@query("crosstab", """with c as (select l_returnflag a, cast(l_linenumber as integer) b, count(*) n from lineitem group by 1, 2)
select a, b, n, round(n / cast(sum(n) over (partition by a) as double), 6) row_share from c""")
def crosstab(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linenumber").alias("b"))
    return S.crosstab(li, "a", "b").select("a", "b", "n", rnd("row_share").alias("row_share"))


@query("cramers_v", """with c as (select quality, toxic, count(*) n from labels group by 1, 2),
g as (select q.quality, x.toxic, coalesce(c.n, 0) n from (select distinct quality from labels) q cross join (select distinct toxic from labels) x
  left join c on c.quality = q.quality and c.toxic = x.toxic),
e as (select *, sum(n) over (partition by quality) * sum(n) over (partition by toxic) / cast(sum(n) over () as double) e from g),
s as (select cast(sum(n) as bigint) n, sum((n - e) * (n - e) / e) chi2, least(count(distinct quality), count(distinct toxic)) - 1 k from e)
select n, round(chi2, 6) chi2, round(sqrt(chi2 / n / k), 6) cramers_v from s""")
def cramers_v(spark, sf):
    return _rounded(S.cramers_v(table(spark, sf, "labels"), "quality", "toxic"))


@query("direction_label_association", f"""with {SQL_DAY},
d as (select t, cast(sign(close - lag(close) over (order by t)) as integer) direction from bars_day where id = '1-URGENT'),
n as (select t, case when close > open then 'positive' when close < open then 'negative' else 'neutral' end as label from bars_day where id = '2-HIGH'),
j as (select direction, label from d join n using (t) where direction is not null),
c as (select direction, label, count(*) n from j group by 1, 2)
select direction, label, n, round(n / cast(sum(n) over (partition by direction) as double), 6) row_share,
  (select round(corr(direction, case label when 'positive' then 1 when 'negative' then -1 else 0 end), 6) from j) r from c""")
def direction_label_association(spark, sf):
    """P(label | direction) of one series against another's label, and their plain correlation."""
    b = bars_day(spark, sf)
    d = I.direction(b.filter("id = '1-URGENT'"), DAY, "close").select("t", "direction")
    up, dn = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    n = b.filter("id = '2-HIGH'").select("t", F.when(up, "positive").when(dn, "negative").otherwise("neutral").alias("label"))
    j = stage(A.common_dates(d, n), "direction-label")
    r = j.agg(F.corr("direction", A.encode_label("label"))).scalar()
    out = S.crosstab(j, "direction", "label").filter("n > 0").withColumn("r", r)
    return out.select("direction", "label", "n", rnd("row_share").alias("row_share"), rnd("r").alias("r"))


@query("corr_with", """select * from (select round(corr(l_extendedprice, l_quantity), 6) l_quantity, round(corr(l_extendedprice, l_discount), 6) + 0.0 l_discount,
  round(corr(l_extendedprice, l_tax), 6) + 0.0 l_tax from lineitem) unpivot (r for feature in (l_quantity, l_discount, l_tax))""")
def corr_with(spark, sf):
    out = S.corr_with(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return S.order_by_abs(out, "r").select("feature", rnd("r").alias("r"))


FEATS = ["open", "high", "low", "close"]
LONG_SQL = f"""{SQL_DAY}, common as (select t from bars_day group by 1 having count(*) = 5),
long_ as (select t, id || '_' || feature feature, value from (select id, t, open, high, low, close from bars_day)
  unpivot (value for feature in (open, high, low, close)) where t in (select t from common)),
cm as (select a.feature f1, b.feature f2, corr(a.value, b.value) r from long_ a join long_ b using (t) group by 1, 2)"""


def _long(spark, sf):
    b = bars_day(spark, sf)
    full = b.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n = 5")
    x = A.to_long(b.join(full, "t", "left_semi"), DAY, FEATS)
    return x.select("t", F.concat_ws("_", "id", "feature").alias("feature"), "value")


def _corr(spark, sf, **kw):
    return S.corr_matrix(stage(_long(spark, sf), "features"), **kw)


@query("zscore", time="t", sql=f"""with {LONG_SQL}, s as (select feature, avg(value) m, stddev_samp(value) s from long_ group by 1)
select t, feature, round((value - m) / greatest(s, 1e-8), 6) + 0.0 z from long_ join s using (feature)""")
def zscore(spark, sf):
    return S.zscore(_long(spark, sf)).select("t", "feature", rnd("z").alias("z"))


@query("corr_matrix", f"with {LONG_SQL} select f1, f2, round(r, 6) + 0.0 r from cm")
def corr_matrix(spark, sf):
    return _corr(spark, sf).select("f1", "f2", rnd("r").alias("r"))


@query("corr_matrix_scaled", f"""with {LONG_SQL}, n as (select count(*) n from common)
select f1, f2, round(r * (n - 1) / n, 6) + 0.0 r from cm, n""")
def corr_matrix_scaled(spark, sf):
    """The variant whose diagonal is (T-1)/T, with several blocks of features."""
    return _corr(spark, sf, ddof_scale=True, block=6).select("f1", "f2", rnd("r").alias("r"))


HOLES_SQL = f"""{SQL_DAY}, long_ as (select t, id || '_' || feature feature, value
  from (select id, t, open, high, low, close from bars_day) unpivot (value for feature in (open, high, low, close))
  where (dayofyear(t) + length(id) + length(feature)) % 4 <> 0)"""


@query("corr_matrix_with_holes", f"""with {HOLES_SQL}
select a.feature f1, b.feature f2, round(corr(a.value, b.value), 6) + 0.0 r from long_ a join long_ b using (t)
group by 1, 2 having count(*) >= 2""")
def corr_matrix_with_holes(spark, sf):
    """Every feature lacks dates of its own; a pair counts the dates that both have."""
    x = A.to_long(bars_day(spark, sf), DAY, FEATS)
    x = x.filter("(dayofyear(t) + length(id) + length(feature)) % 4 <> 0")
    x = x.select("t", F.concat_ws("_", "id", "feature").alias("feature"), "value")
    return S.corr_matrix(stage(x, "features"), block=7).filter("r is not null").select("f1", "f2", rnd("r").alias("r"))


@query("row_softmax", f"""with {LONG_SQL}, t as (select * from cm where f2 like '%close'),
e as (select f1, f2, exp((r - max(r) over (partition by f1)) / 0.1) e from t)
select f1, f2, round(e / sum(e) over (partition by f1), 6) attention from e""")
def row_softmax(spark, sf):
    out = S.row_softmax(_corr(spark, sf).filter("f2 like '%close'"))
    return out.select("f1", "f2", rnd("attention").alias("attention"))


TARGETS = "f2 like '%close' and f1 not like '%close'"


@query("relevant_features", f"""with {LONG_SQL} select f1, round(max(abs(r)), 6) max_abs_r from cm where {TARGETS} group by 1 having max(abs(r)) > 0.05""")
def relevant_features(spark, sf):
    out = S.relevant_features(_corr(spark, sf).filter(TARGETS), 0.05)
    return out.select("f1", rnd("max_abs_r").alias("max_abs_r"))


@query("redundant_pairs", f"""with {LONG_SQL}, k as (select f1 from cm where {TARGETS} group by 1 having max(abs(r)) > 0.05)
select f1, f2, round(r, 6) r from cm where f1 < f2 and abs(r) > 0.1 and f1 in (select * from k) and f2 in (select * from k)""")
def redundant_pairs(spark, sf):
    corr = stage(_corr(spark, sf), "correlations")
    keep = S.relevant_features(corr.filter(TARGETS), 0.05)
    return S.redundant_pairs(corr, keep, 0.1).select("f1", "f2", rnd("r").alias("r"))


@query("highlight_cells", f"""with {LONG_SQL}
select f1, f2, f1 <> f2 and (r > 0.3 or ((select min(r) from cm) < 0 and r < -0.3)) marked from cm""")
def highlight_cells(spark, sf):
    return S.highlight(stage(_corr(spark, sf), "correlations"), 0.3).select("f1", "f2", "marked")


@query("n_relevant", f"""with {LONG_SQL} select count(*) filter (abs(r) > 0.05) n_relevant, count(*) n_total from cm where {TARGETS}""")
def n_relevant(spark, sf):
    return S.n_relevant(_corr(spark, sf).filter(TARGETS), 0.05)


@query("embedding_pca")
def embedding_pca(spark, sf):
    out = S.embedding_pca(scored(spark, sf), ["vec_id"], "embedding", 10)
    return out.select("vec_id", *[rnd(f"pc{i + 1}").alias(f"pc{i + 1}") for i in range(10)])


@query("embedding_pca_variance")
def embedding_pca_variance(spark, sf):
    """Variance of each component score, which does not depend on its sign."""
    pcs = [f"pc{i + 1}" for i in range(10)]
    out = S.embedding_pca(scored(spark, sf), ["vec_id"], "embedding", 10)
    return out.agg(*[F.var_samp(c).alias(c) for c in pcs]).unpivot([], pcs, "component", "variance")


@query("embedding_pca_trace", """select count(*) n_components, round(sum(v), 6) variance from (
  select i, var_samp(cast(x as double)) v from (select generate_subscripts(embedding, 1) i, unnest(embedding) x from embeddings) group by i)""")
def embedding_pca_trace(spark, sf):
    """All components together hold the variance of the vectors."""
    pcs = [f"pc{i + 1}" for i in range(64)]
    out = S.embedding_pca(scored(spark, sf), ["vec_id"], "embedding", 64)
    var = out.agg(*[F.var_samp(c).alias(c) for c in pcs]).unpivot([], pcs, "component", "variance")
    return var.agg(F.count("*").alias("n_components"), F.round(F.sum("variance"), 6).alias("variance"))


@query("dataset_summary", time="first_t last_t", sql=f"""with {SQL_DAY}
select 'bars' as "table", count(*) n_rows, cast(min(t) as timestamp) first_t, cast(max(t) as timestamp) last_t, 0 n_null, cast(0 as double) null_pct from bars_day
union all select 'orders', count(*), min(o_orderdate), max(o_orderdate), cast(sum(cast(o_totalprice < 2000 as int)) as bigint),
  round(sum(cast(o_totalprice < 2000 as int)) * 100 / (count(*) * 6.0), 6) from orders""")
def dataset_summary(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderdate", "t").withColumn(
        "o_totalprice", F.when(F.col("o_totalprice") >= 2000, F.col("o_totalprice")))
    b = bars_day(spark, sf).withColumn("t", F.col("t").cast("timestamp_ntz"))
    return _rounded(S.dataset_summary({"bars": b, "orders": o}, "t"))


@query("top_moves", time="t", sql=f"""with {SQL_DAY}, r as (select id, t, (close / lag(close) over (partition by id order by t) - 1) * 100 ret from bars_day)
select id, t, round(ret, 4) ret from r where ret is not null order by ret desc, id, t limit 10""")
def top_moves(spark, sf):
    r = rolled(bars_day(spark, sf), DAY, lambda w: {"ret": I.daily_return("close", w)}, back=1)
    return S.top_rows(r, "ret", 10, ties=("id", "t")).select("id", "t", rnd("ret", 4).alias("ret"))


@query("bottom_moves", time="t", sql=f"""with {SQL_DAY}, r as (select id, t, (close / lag(close) over (partition by id order by t) - 1) * 100 ret from bars_day)
select id, t, round(ret, 4) ret from r where ret is not null order by ret, id, t limit 10""")
def bottom_moves(spark, sf):
    r = rolled(bars_day(spark, sf), DAY, lambda w: {"ret": I.daily_return("close", w)}, back=1)
    return S.top_rows(r, "ret", 10, largest=False, ties=("id", "t")).select("id", "t", rnd("ret", 4).alias("ret"))


@query("topk_positions", """with w as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings),
u as (select vec_id, unnest(e) w, generate_subscripts(e, 1) - 1 i from w),
r as (select *, row_number() over (partition by vec_id order by w desc, i) hi, row_number() over (partition by vec_id order by w, i) lo from u)
select vec_id, string_agg(i, '|' order by hi) filter (hi <= 5) top, string_agg(i, '|' order by lo) filter (lo <= 5) bottom from r group by 1""")
def topk_positions(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.array_join(S.topk_index("embedding", 5), "|").alias("top"),
                    F.array_join(S.topk_index("embedding", 5, largest=False), "|").alias("bottom"))


@query("sorted_ids", "select distinct o_orderpriority id from orders")
def sorted_ids(spark, sf):
    return S.sorted_ids(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "id"))


@query("id_set_algebra", """with a as (select distinct l_suppkey k from lineitem where l_quantity > 49), b as (select s_suppkey k from supplier)
select (select count(*) from a join b using (k)) n_both, (select count(*) from b where k not in (select k from a)) n_only_b""")
def id_set_algebra(spark, sf):
    """Sets of ids: intersection and difference as distributed set operators."""
    a = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("k"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    both = a.intersect(b).agg(F.count(F.lit(1)).alias("n_both"))
    return both.withColumn("n_only_b", b.subtract(a).agg(F.count(F.lit(1))).scalar())
