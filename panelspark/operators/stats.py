"""Summaries, shares, histograms, association, correlation and token distributions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.schema import Series
from panelspark.session import stage

SALTS = 16


# ── exact quantiles of groups of any size ───────────────────────────────────
def exact_percentiles(df: DataFrame, by: list[str], col: str, qs: list[float],
                      accuracy: int = 100_000, name: str = "value") -> DataFrame:
    """Linear-interpolation quantiles, exact, one row per (group, q).

    The built-in exact percentile gathers a group's distinct values in one buffer, which a hot
    group outgrows. Here a mergeable sketch brackets each wanted rank, rows below the bracket are
    only counted, and the few rows inside it, already merged by value, are ranked. The sketch is
    off by at most n / accuracy ranks and the bracket reaches 4 n / accuracy either way, so from
    n = accuracy on both neighbours of the rank are inside; the bracket of a smaller group is the
    group. A rank outside its bracket raises.
    """
    x = F.col(col).cast("double")
    src = df.filter(x.isNotNull()).select(*by, x.alias("_x"))
    pad = 4 / accuracy
    edges = [e for q in qs for e in (max(q - pad, 0.0), min(q + pad, 1.0))]
    stats = src.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
        F.percentile_approx("_x", edges, accuracy).alias("_e"))
    small = F.col("_n") < accuracy
    def edge(i, end, at_end):
        return F.col(end) if at_end else F.when(small, F.col(end)).otherwise(F.col("_e")[i])
    wanted = F.array(*[F.struct(
        F.lit(float(q)).alias("q"),
        edge(2 * i, "_min", q - pad <= 0).alias("lo"),
        edge(2 * i + 1, "_max", q + pad >= 1).alias("hi"))
        for i, q in enumerate(qs)])
    brackets = stats.select(*by, "_n", F.explode(wanted).alias("_b")).select(
        *by, "_n", F.col("_b.q").alias("q"), F.col("_b.lo").alias("_lo"), F.col("_b.hi").alias("_hi"))
    packed = brackets.groupBy(*by).agg(F.collect_list(F.struct("q", "_lo", "_hi", "_n")).alias("_w"))
    if by:
        # written, they have a size that Spark knows and are mostly sent to all tasks; groups too many for
        # that meet their brackets in parts, so that no task holds a whole group
        packed = stage(packed, "brackets").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = src.withColumn("_salt", F.pmod(F.xxhash64("_x"), F.lit(SALTS)).cast("int")).join(packed, [*by, "_salt"])
    else:
        joined = src.withColumn("_w", packed.scalar())
    # a value sorts to one of: below the bracket (counted only) or inside it (kept)
    place = F.explode(F.filter("_w", lambda b: F.col("_x") <= b["_hi"]))
    inside = joined.select(*by, "_x", place.alias("_b")).select(
        *by, F.col("_b.q").alias("q"), F.col("_b._n").alias("_n"),
        F.when(F.col("_x") >= F.col("_b._lo"), F.col("_x")).alias("_v"))
    counts = inside.groupBy(*by, "q", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by, "q").orderBy(F.col("_v").asc_nulls_first())
    ranked = counts.withColumn("_end", F.sum("_c").over(w))
    h = (F.col("_n") - 1) * F.col("q")
    lo, hi = F.floor(h) + 1, F.ceil(h) + 1
    hit = ranked.groupBy(*by, "q", "_n").agg(
        F.min(F.when(F.col("_end") >= lo, F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_end") >= hi, F.col("_v"))).alias("_z"),
        F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("_below"))
    frac = h - F.floor(h)
    inside = (F.col("_below") < lo) & F.col("_z").isNotNull()
    value = F.when(inside, F.col("_a") + (F.col("_z") - F.col("_a")) * frac).otherwise(
        F.raise_error(F.lit("a quantile's rank is outside its bracket")).cast("double"))
    return hit.select(*by, "q", value.alias(name))


def describe(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """count, mean, std, min, quartiles, max; the quartiles are exact."""
    qs = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    quart = exact_percentiles(df, by, col, list(qs))
    wide = quart.groupBy(*by).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n)
                                    for q, n in qs.items()])
    base = df.groupBy(*by).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"))
    if by:
        return base.join(wide, by)
    # one subquery brings all quartiles
    return (base.withColumn("_q", wide.select(F.struct(*qs.values())).scalar())
            .withColumns({n: F.col("_q")[n] for n in qs.values()}).drop("_q"))


def describe_series(df: DataFrame, s: Series, col: str) -> DataFrame:
    return df.groupBy(*s.keys).agg(F.min(col).alias("min"), F.max(col).alias("max"),
                                   F.avg(col).alias("mean"), F.count(col).alias("n"))


def value_shares(df: DataFrame, col: str, domain: list) -> DataFrame:
    """Count and share of each value of a fixed domain, in its order, zeros included."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum(F.when(F.col("value").isin(domain), F.col("n"))))
    wanted = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(domain)],
                                             f"position int, value {dict(df.dtypes)[col]}")
    out = wanted.join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", F.try_divide(F.col("n"), total.scalar()))


def mean_by(df: DataFrame, by: list, col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(col).alias("mean"), F.count(col).alias("n"))


def calendar_composition(df: DataFrame, t: str = "t", flag: str = "trading_day") -> DataFrame:
    """Trading and non-trading rows per year."""
    return df.groupBy(F.year(t).alias("year")).agg(
        F.sum((F.col(flag) == 1).cast("int")).alias("trading"),
        F.sum((F.col(flag) != 1).cast("int")).alias("non_trading"))


def histogram(df: DataFrame, col: str, bins: int, lo: Column, hi: Column,
              density: bool = False) -> DataFrame:
    """Equal-width counts or densities; the last bin is closed, values outside the range are not
    counted, empty bins are zero. `lo` and `hi` may be literals or scalar subqueries."""
    spark = df.sparkSession
    x = df.select(F.col(col).cast("double").alias("x")).withColumns({"_lo": lo, "_hi": hi})
    x = x.filter(F.col("x").between(F.col("_lo"), F.col("_hi")))
    at = F.least(F.floor((F.col("x") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)),
                 F.lit(bins - 1))
    counts = x.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    out = (spark.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left")
           .withColumn("n", F.coalesce("n", F.lit(0)))
           .withColumns({"_lo": lo, "_hi": hi}))
    width = (F.col("_hi") - F.col("_lo")) / bins
    out = out.withColumns({"left": F.col("_lo") + F.col("bin") * width,
                           "right": F.col("_lo") + (F.col("bin") + 1) * width})
    if density:
        out = out.withColumn("density", F.col("n") / (total * width))
    return out.drop("_lo", "_hi")


def clipped_range(df: DataFrame, col: str, low_q: float, high_q: float) -> tuple[Column, Column]:
    """The quantiles a histogram is clipped to: two fields of one scalar."""
    q = exact_percentiles(df, [], col, [low_q, high_q]).agg(F.struct(
        F.max(F.when(F.col("q") == low_q, F.col("value"))).alias("lo"),
        F.max(F.when(F.col("q") == high_q, F.col("value"))).alias("hi")))
    return q.scalar()["lo"], q.scalar()["hi"]


def year_histogram(df: DataFrame, t: str, first: int, last: int) -> DataFrame:
    """Rows per year with empty years."""
    counts = df.groupBy(F.year(t).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    years = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return years.join(counts, "year", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# ── association ─────────────────────────────────────────────────────────────
def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts and row shares in long form, cells of the full grid, zeros included."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count(F.lit(1)).alias("n"))
    values = cells.agg(F.array_sort(F.collect_set(b)).alias("_bs"))
    grid = (cells.select(a).distinct().withColumn("_bs", values.scalar())
            .select(a, F.explode("_bs").alias(b)))
    out = grid.join(cells, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi-square, Cramer's V without bias correction, n; one row.

    Only cells that occur are needed: chi-square is n (sum of n_ij^2 / (row_i column_j) - 1).
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("_row", F.sum("n").over(Window.partitionBy(a)))
    cells = cells.withColumn("_column", F.sum("n").over(Window.partitionBy(b)))
    stat = cells.agg(F.sum(F.col("n") * F.col("n") / (F.col("_row") * F.col("_column"))).alias("_s"),
                     F.sum("n").alias("n"), F.count_distinct(a).alias("_r"), F.count_distinct(b).alias("_k"))
    stat = stat.withColumn("chi2", F.greatest(F.col("n") * (F.col("_s") - 1), F.lit(0.0)))
    small = F.least(F.col("_r") - 1, F.col("_k") - 1)
    return stat.select("n", "chi2", F.when(small > 0, F.sqrt(F.col("chi2") / F.col("n") / small))
                       .otherwise(F.lit(0.0)).alias("cramers_v"))


def corr_with(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """Pearson of one column against many, in one pass, as (feature, r)."""
    row = df.agg(*[F.corr(target, c).alias(c) for c in cols])
    return row.unpivot([], cols, "feature", "r")


# ── correlation of long features ────────────────────────────────────────────
def zscore(df: DataFrame, by: str = "feature", value: str = "value",
           floor: float = 1e-8) -> DataFrame:
    """(x - mean) / sample std per feature, the std floored so constants become 0."""
    st = df.groupBy(by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return (df.join(st, by)
            .withColumn("z", (F.col(value) - F.col("_m")) / F.greatest("_s", F.lit(floor)))
            .drop("_m", "_s"))


def corr_matrix(df: DataFrame, t: str = "t", feature: str = "feature", value: str = "value",
                block: int = 512, dates_per_chunk: int = 4096,
                ddof_scale: bool = False) -> DataFrame:
    """Pearson of every pair of features over the dates that have both, long `(f1, f2, r)`.

    Z-scores are cut into (chunk of dates x block of features) tiles. Each pair of blocks multiplies
    as small matrices inside a task: values, squares and presence, so that a hole counts for the
    pairs it is in alone. Only block-sized partial sums are shuffled, and no date ever unfolds into
    pairs of rows. Pairs without two common dates have a null, constants a zero.
    `ddof_scale` keeps the factor (T-1)/T of a product of sample z-scores divided by T.
    """
    z = zscore(df.select(t, F.col(feature).alias("feature"), F.col(value).cast("double").alias("value")))
    n_blocks = F.greatest(F.ceil(z.agg(F.count_distinct("feature")).scalar() / block), F.lit(1))
    n = df.agg(F.count_distinct(t)).scalar()
    # products are sums over dates, so any even cut of the dates will do
    z = z.withColumns({"_blocks": n_blocks, "_chunks": F.greatest(F.ceil(n / dates_per_chunk), F.lit(1))})
    z = z.withColumns({"_b": F.pmod(F.xxhash64("feature"), F.col("_blocks")),
                       "_c": F.pmod(F.xxhash64(t), F.col("_chunks"))})
    # a tile takes part in one product per pair of blocks it belongs to
    z = z.withColumn("_o", F.explode(F.expr("sequence(0L, _blocks - 1)")))
    z = z.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")})
    z = z.select("_c", "_i", "_j", "_b", F.col(t).alias("_t"), "feature", "z")
    sums = ["n", "x", "y", "xx", "yy", "xy"]

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        wide = pdf.pivot(index="_t", columns="feature", values="z")
        side = pdf.drop_duplicates("feature").set_index("feature")["_b"]
        fi, fj = [f for f in wide.columns if side[f] == i], [f for f in wide.columns if side[f] == j]
        a, b = wide[fi].to_numpy(dtype=float).T, wide[fj].to_numpy(dtype=float)
        here, there = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
        a, b = np.nan_to_num(a), np.nan_to_num(b)
        got = [here @ there, a @ there, here @ b, (a * a) @ there, here @ (b * b), a @ b]
        return pd.DataFrame({"f1": np.repeat(np.array(fi, dtype=object), len(fj)),
                             "f2": np.tile(np.array(fj, dtype=object), len(fi)),
                             **{k: g.ravel() for k, g in zip(sums, got)}, "mirror": i != j})

    schema = "f1 string, f2 string, " + ", ".join(f"{k} double" for k in sums) + ", mirror boolean"
    parts = z.groupBy("_c", "_i", "_j").applyInPandas(product, schema)
    total = parts.groupBy("f1", "f2", "mirror").agg(*[F.sum(k).alias(k) for k in sums])
    both = F.explode(F.when(F.col("mirror"), F.array(
        F.struct("f1", "f2"), F.struct(F.col("f2").alias("f1"), F.col("f1").alias("f2"))))
        .otherwise(F.array(F.struct("f1", "f2"))))
    n, x, y, xx, yy, xy = (F.col(k) for k in sums)
    vx, vy = xx - x * x / n, yy - y * y / n
    r = F.when(F.least(vx, vy) > 1e-9 * n, (xy - x * y / n) / F.sqrt(vx * vy)).otherwise(F.lit(0.0))
    r = F.when(n >= 2, r * (n - 1) / n if ddof_scale else r)
    return total.select(both.alias("p"), r.alias("r")).select("p.f1", "p.f2", "r")


def row_softmax(df: DataFrame, by: str = "f1", value: str = "r", temp: float = 0.1,
                name: str = "attention") -> DataFrame:
    """Softmax across each row of a score matrix at a temperature."""
    w = Window.partitionBy(by)
    e = F.exp((F.col(value) - F.max(value).over(w)) / temp)
    return df.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def relevant_features(corr: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Features whose largest absolute correlation with any target passes, strongest first."""
    top = corr.groupBy("f1").agg(F.max(F.abs("r")).alias("max_abs_r"))
    return top.filter(F.col("max_abs_r") > threshold).orderBy(F.desc("max_abs_r"), "f1")


def n_relevant(corr: DataFrame, threshold: float = 0.25) -> DataFrame:
    return corr.agg(F.count_if(F.abs("r") > threshold).alias("n_relevant"),
                    F.count(F.lit(1)).alias("n_total"))


def redundant_pairs(corr: DataFrame, survivors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs of survivors that nearly repeat each other, each once, strongest first."""
    keep = corr.filter((F.col("f1") < F.col("f2")) & (F.abs("r") > threshold))
    for side in ("f1", "f2"):
        keep = keep.join(survivors.select(F.col("f1").alias(side)), side, "left_semi")
    return keep.select("f1", "f2", "r").orderBy(F.abs("r").desc(), "f1", "f2")


def highlight(corr: DataFrame, threshold: float) -> DataFrame:
    """Mark cells past the threshold, off the diagonal; the negative side only if it exists."""
    any_negative = corr.agg(F.min("r") < 0).scalar()
    mark = (F.col("f1") != F.col("f2")) & (
        (F.col("r") > threshold) | (any_negative & (F.col("r") < -threshold)))
    return corr.withColumn("marked", mark)


def order_by_abs(df: DataFrame, col: str, *ties: str) -> DataFrame:
    return df.orderBy(F.abs(col).desc(), *ties)


def embedding_pca(df: DataFrame, key: list[str], vector: str, k: int = 10) -> DataFrame:
    """Centred principal component scores of a vector column, `pc1..pck`.

    The components come from the distributed covariance of the vectors; what reaches the driver
    is the width x k loading matrix.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    v = df.select(*key, array_to_vector(F.col(vector)).alias("_v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(v).transform(v)
    scores = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred)
    return (scores.withColumn("_a", vector_to_array("_p"))
            .select(*key, *[F.col("_a")[i].alias(f"pc{i + 1}") for i in range(k)]))


# ── tokens ──────────────────────────────────────────────────────────────────
def token_distribution(df: DataFrame, by: list[str], tok: str) -> DataFrame:
    """Pooled token probabilities, sparse: only tokens that occur."""
    counts = df.groupBy(*by, F.col(tok).alias("token_id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def token_distribution_per_window(df: DataFrame, by: list[str], tokens: str) -> DataFrame:
    """Mean over windows of each window's own distribution; absent tokens count as zero."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    share = (df.select(*by, (1.0 / F.size(tokens)).alias("_w"), F.explode(tokens).alias("token_id"))
             .groupBy(*by, "token_id").agg(F.sum("_w").alias("_s")))
    return share.join(n, by).select(*by, "token_id", (F.col("_s") / F.col("_n")).alias("p"))


def dense_distribution(dist: DataFrame, by: list[str], n_tokens: int = 4096) -> DataFrame:
    """Zero-filled over the vocabulary, for a sink that wants full vectors."""
    grid = dist.select(*by).distinct().select(
        *by, F.explode(F.sequence(F.lit(0), F.lit(n_tokens - 1))).alias("token_id"))
    return grid.join(dist.select(*by, "token_id", "p"), [*by, "token_id"], "left").na.fill(0.0, ["p"])


def distribution_summary(dist: DataFrame, by: list[str], n_tokens: int = 4096,
                         n_special: int = 2) -> DataFrame:
    """Counts, range, mean and population deviation, entropy, perplexity, special-token mass."""
    p, tok = F.col("p"), F.col("token_id")
    m = F.sum(p * tok)
    entropy = -F.sum(p * F.log2(p))
    return dist.groupBy(*by).agg(
        F.sum("n").alias("n_tokens_emitted"), F.count(F.lit(1)).alias("unique_tokens"),
        (F.count(F.lit(1)) / n_tokens).alias("vocab_coverage"), F.min(tok).alias("token_id_min"),
        F.max(tok).alias("token_id_max"), m.alias("token_id_mean"),
        F.sqrt(F.greatest(F.sum(p * tok * tok) - m * m, F.lit(0.0))).alias("token_id_std"),
        entropy.alias("entropy_bits"), F.pow(F.lit(2.0), entropy).alias("perplexity"),
        F.sum(F.when(tok < n_special, p).otherwise(0.0)).alias("special_token_mass"))


def central_span(dist: DataFrame, by: list[str], mass: float) -> DataFrame:
    """First token ids where the cumulative share reaches each of the two tail quantiles."""
    tail = (1 - mass) / 2
    w = Window.partitionBy(*by)
    cdf = F.sum("n").over(w.orderBy("token_id")) / F.sum("n").over(w)
    c = dist.withColumn("_cdf", cdf)
    at = lambda q: F.min(F.when(F.col("_cdf") >= q - 1e-12, F.col("token_id")))
    return c.groupBy(*by).agg(at(tail).alias("lo"), at(1 - tail).alias("hi"))


# ── table summaries, extremes ───────────────────────────────────────────────
def dataset_summary(tables: dict[str, DataFrame], t: str) -> DataFrame:
    """Rows, span and missing cells of each table, each from one scan."""
    out = None
    for name, df in tables.items():
        nulls = sum((F.sum(F.col(f"`{c}`").isNull().cast("int")) for c in df.columns), F.lit(0))
        row = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"),
                     F.min(t).alias("first_t"), F.max(t).alias("last_t"), nulls.alias("n_null"),
                     F.try_divide(nulls * 100.0, F.count(F.lit(1)) * len(df.columns)).alias("null_pct"))
        out = row if out is None else out.unionByName(row)
    return out


def top_rows(df: DataFrame, col: str, n: int, largest: bool = True, ties: tuple = ()) -> DataFrame:
    """The n largest or smallest rows; each task keeps n, the driver merges n per task."""
    order = F.desc_nulls_last(col) if largest else F.asc_nulls_last(col)
    return df.filter(F.col(col).isNotNull()).orderBy(order, *ties).limit(n)


def sorted_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(key).distinct().orderBy(key)


def topk_index(weights, k: int, largest: bool = True) -> Column:
    """0-based positions of the k largest (or smallest) weights, best first, ties by position."""
    pairs = F.transform(weights, lambda w, i: F.struct((-w if largest else w).alias("w"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])
