"""Splits, windows and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog import query
from panelspark.catalog.inputs import DAY, HOUR, SQL_DAY, SQL_HOUR, bars_day, bars_hour, rnd, table
from panelspark.operators import stats as S
from panelspark.operators import windows as X
from panelspark.schema import Series

STEP = X._step(X.LOW, X.HIGH, X.N_TOKENS, X.N_SPECIAL)
BINS = X.N_TOKENS - X.N_SPECIAL - 1


def token_sql(x: str, s: str) -> str:
    at = f"floor(({x} / ({s}) - cast({X.LOW} as double)) / cast({STEP!r} as double) + cast(0.5 as double)) + 1"
    return f"cast(least(greatest({at}, 1), {BINS}) + {X.N_SPECIAL} as integer)"


@query("temporal_split", time="t", sql=f"""with {SQL_DAY},
n as (select id, t, row_number() over (partition by id order by t) - 1 p, count(*) over (partition by id) n from bars_day),
b as (select *, greatest(n - 250, 0) te, greatest(greatest(n - 250, 0) - 250, 0) va from n)
select id, t, 'train' split from b where p < va union all
select id, t, 'val' from b where p >= greatest(va - 150, 0) and p < te union all
select id, t, 'test' from b where p >= greatest(te - 150, 0)""")
def temporal_split(spark, sf):
    return X.temporal_split(bars_day(spark, sf), DAY).select("id", "t", "split")


def win_sql(ctx: int, pred: int) -> str:
    return f"""{SQL_HOUR},
r as (select id, t, close, row_number() over (partition by id order by t) rn,
  list(close) over (partition by id order by t rows between {ctx} preceding and 1 preceding) x,
  list(close) over (partition by id order by t rows between current row and {pred - 1} following) y from bars_hour),
win as (select id, rn - {ctx} as "window", t start_t, x, y from r where len(x) = {ctx} and len(y) = {pred})"""


CTX, PRED = 30, 7


def _windows(spark, sf, cols=None):
    return X.sliding_windows(bars_hour(spark, sf), HOUR, CTX, PRED, "close", cols)


@query("sliding_windows", time="start_t", sql=f"""with {win_sql(CTX, PRED)}
select id, "window", start_t, round(list_sum(x), 4) x_sum, round(x[1], 4) x_first, round(x[{CTX}], 4) x_last,
  round(y[1], 4) y_first, round(y[{PRED}], 4) y_last, len(x) + len(y) n from win""")
def sliding_windows(spark, sf):
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return _windows(spark, sf).select(
        "id", "window", "start_t", rnd(total, 4).alias("x_sum"), rnd(F.element_at("x", 1), 4).alias("x_first"),
        rnd(F.element_at("x", -1), 4).alias("x_last"), rnd(F.element_at("y", 1), 4).alias("y_first"),
        rnd(F.element_at("y", -1), 4).alias("y_last"), (F.size("x") + F.size("y")).alias("n"))


@query("window_counts", f"""with {SQL_HOUR} select id, count(*) - {CTX} - {PRED} + 1 n_windows from bars_hour group by 1""")
def window_counts(spark, sf):
    return _windows(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("n_windows"))


@query("vector_windows", sql="""with r as (select cast(vec_id % 5 as bigint) id, vec_id,
  list(embedding) over (partition by vec_id % 5 order by vec_id rows between 10 preceding and 1 preceding) x,
  list(label) over (partition by vec_id % 5 order by vec_id rows between current row and 2 following) y,
  row_number() over (partition by vec_id % 5 order by vec_id) rn from embeddings)
select id, rn - 10 as "window", vec_id start_t, round(cast(x[1][1] as double) + x[10][64], 6) + 0.0 corner,
  cast(list_sum(y) as bigint) y_sum from r where len(x) = 10 and len(y) = 3""")
def vector_windows(spark, sf):
    """Context over whole embedding vectors."""
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 5).alias("id"), "vec_id", "embedding", "label")
    out = X.sliding_windows(e, Series(("id",), "vec_id"), 10, 3, "label", ["embedding"])
    corner = F.element_at(F.element_at("x_embedding", 1), 1).cast("double") + F.element_at(F.element_at("x_embedding", 10), 64)
    return out.select("id", "window", "start_t", rnd(corner).alias("corner"),
                      F.aggregate("y", F.lit(0), lambda a, v: a + v).cast("long").alias("y_sum"))


@query("mean_abs_scale", f"""with {SQL_HOUR},
n as (select *, row_number() over (partition by id order by t) rn, count(*) over (partition by id) n from bars_hour)
select id, round(avg(abs(close)), 6) scale from n where rn <= greatest(greatest(n - 100, 0) - 100, 0) group by 1""")
def mean_abs_scale(spark, sf):
    parts = X.temporal_split(bars_hour(spark, sf), HOUR, 100, 100, 30)
    return X.global_scale(parts.filter("split = 'train'"), HOUR, "close").select("id", rnd("scale").alias("scale"))


TOK_SQL = f"""{win_sql(CTX, PRED)},
sc as (select *, case when list_avg(list_transform(x, lambda v: abs(v))) > 0 then list_avg(list_transform(x, lambda v: abs(v))) else 1 end scale from win),
tk as (select *, list_transform(x, lambda v: {token_sql("v", "scale")}) xt, list_transform(y, lambda v: {token_sql("v", "scale")}) yt from sc)"""


@query("tokenize_windows", f"""with {TOK_SQL}
select id, "window", round(scale, 6) scale, array_to_string(yt, '|') y_tok, cast(list_sum(xt) as bigint) x_tok_sum from tk""")
def tokenize_windows(spark, sf):
    out = X.tokenize_windows(_windows(spark, sf))
    return out.select("id", "window", rnd("scale").alias("scale"), F.array_join("y_tok", "|").alias("y_tok"),
                      F.aggregate("x_tok", F.lit(0), lambda a, v: a + v).cast("long").alias("x_tok_sum"))


@query("detokenize", time="t", sql=f"""with {SQL_HOUR}, s as (select id, avg(abs(close)) scale from bars_hour group by 1),
k as (select id, t, close, scale, {token_sql("close", "scale")} tok from bars_hour join s using (id))
select id, t, tok, round((least(greatest(tok - {X.N_SPECIAL + 1}, 0), {BINS - 1}) * cast({STEP!r} as double) + cast({X.LOW} as double)) * scale, 6) + 0.0 back from k""")
def detokenize(spark, sf):
    b = bars_hour(spark, sf)
    k = b.join(X.global_scale(b, HOUR, "close"), "id").withColumn("tok", X.token(F.col("close"), F.col("scale")))
    return k.select("id", "t", "tok", rnd(X.detoken(F.col("tok"), F.col("scale"))).alias("back"))


@query("window_report", time="first_start last_start", sql=f"""with {TOK_SQL}
select id, count(*) n_windows, min(list_min(xt)) x_tok_min, max(list_max(xt)) x_tok_max, round(avg(list_avg(xt)), 6) x_tok_mean,
  min(list_min(yt)) y_tok_min, max(list_max(yt)) y_tok_max, round(avg(list_avg(yt)), 6) y_tok_mean,
  round(min(scale), 6) scale_min, round(avg(scale), 6) scale_mean, round(max(scale), 6) scale_max,
  min(start_t) first_start, max(start_t) last_start from tk group by 1""")
def window_report(spark, sf):
    out = X.window_report(X.tokenize_windows(_windows(spark, sf)), ["id"])
    double = {"x_tok_mean", "y_tok_mean", "scale_min", "scale_mean", "scale_max"}
    return out.select(*[rnd(c).alias(c) if c in double else c for c in out.columns])


@query("naive_forecast", f"""with {win_sql(CTX, PRED)}
select id, "window", cast(h as integer) horizon, round(x[{CTX}], 6) naive from win, generate_series(1, {PRED}) g(h)""")
def naive_forecast(spark, sf):
    return X.naive_forecast(_windows(spark, sf), ["id"], PRED).select("id", "window", "horizon", rnd("naive").alias("naive"))


DIST_SQL = f"""{SQL_HOUR}, s as (select id, avg(abs(close)) scale from bars_hour group by 1),
k as (select id, {token_sql("close", "scale")} token_id from bars_hour join s using (id)),
d as (select id, token_id, count(*) n, count(*) / cast(sum(count(*)) over (partition by id) as double) p from k group by 1, 2)"""


def _dist(spark, sf):
    b = bars_hour(spark, sf)
    k = b.join(X.global_scale(b, HOUR, "close"), "id").withColumn("token_id", X.token(F.col("close"), F.col("scale")))
    return S.token_distribution(k, ["id"], "token_id")


@query("token_distribution", f"""with {DIST_SQL} select id, token_id, n, round(p, 9) p from d""")
def token_distribution(spark, sf):
    return _dist(spark, sf).select("id", "token_id", "n", rnd("p", 9).alias("p"))


@query("token_distribution_per_window", f"""with {TOK_SQL}, u as (select id, "window", unnest(xt) token_id from tk),
w as (select id, "window", token_id, count(*) / cast({CTX} as double) p from u group by 1, 2, 3),
n as (select id, count(*) n from tk group by 1)
select w.id, token_id, round(sum(p) / max(n.n), 9) p from w join n using (id) group by 1, 2""")
def token_distribution_per_window(spark, sf):
    tok = X.tokenize_windows(_windows(spark, sf))
    return S.token_distribution_per_window(tok, ["id"], "x_tok").select("id", "token_id", rnd("p", 9).alias("p"))


@query("token_summary", f"""with {DIST_SQL}
select id, cast(sum(n) as bigint) n_tokens_emitted, count(*) unique_tokens, round(count(*) / 4096.0, 9) vocab_coverage,
  min(token_id) token_id_min, max(token_id) token_id_max, round(sum(p * token_id), 6) token_id_mean,
  round(sqrt(sum(p * token_id * token_id) - sum(p * token_id) * sum(p * token_id)), 4) token_id_std,
  round(-sum(p * log2(p)), 6) entropy_bits, round(pow(2, -sum(p * log2(p))), 6) perplexity,
  round(sum(case when token_id < 2 then p else 0 end), 6) special_token_mass from d group by 1""")
def token_summary(spark, sf):
    out = S.distribution_summary(_dist(spark, sf), ["id"])
    places = {"token_id_std": 4, "vocab_coverage": 9}
    ints = {"id", "n_tokens_emitted", "unique_tokens", "token_id_min", "token_id_max"}
    return out.select(*[c if c in ints else rnd(c, places.get(c, 6)).alias(c) for c in out.columns])


@query("token_central_span", f"""with {DIST_SQL},
c as (select id, token_id, sum(n) over (partition by id order by token_id) / cast(sum(n) over (partition by id) as double) cdf from d)
select id, min(case when cdf >= 0.05 - 1e-12 then token_id end) lo, min(case when cdf >= 0.95 - 1e-12 then token_id end) hi from c group by 1""")
def token_central_span(spark, sf):
    return S.central_span(_dist(spark, sf), ["id"], 0.9)
