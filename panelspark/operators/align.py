"""Feature selection, joins on time, reindexing and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.segments import BUCKET, Carry, Running, bucket_of, bucket_step, running, so_far
from panelspark.schema import Series

PRICES = ("open", "high", "low", "close", "volume")
SALTS, COPIES, TASK_ROWS = 16, 4_096, 1 << 21


def clean_prefix(c) -> Column:
    """Index tickers lose their leading caret."""
    return F.regexp_replace(c, r"^\^", "")


def feature_name(prefix, feature) -> Column:
    """`{prefix}_{feature}`, prices in lower case, indicators as they are."""
    low = F.lower(feature)
    return F.concat_ws("_", clean_prefix(prefix),
                       F.when(low.isin(*PRICES), low).otherwise(F.col(feature)))


def select_features(df: DataFrame, wanted: list[tuple[str, list[str]]], key: str = "id",
                    t: str = "t") -> DataFrame:
    """One column `{id}_{feature}` per request, in request order, one row per date."""
    cols = [F.max(F.when(F.col(key) == i, F.col(f))).alias(f"{i}_{f}")
            for i, fs in wanted for f in fs]
    return df.filter(F.col(key).isin([i for i, _ in wanted])).groupBy(t).agg(*cols)


def to_long(df: DataFrame, s: Series, cols: list[str]) -> DataFrame:
    """(key, t, feature, value): the form every width-dependent step works on."""
    return df.unpivot([*s.keys, s.t], cols, "feature", "value")


def align_outer(df: DataFrame, values: list[str], key: str = "id", t: str = "t",
                value: str = "close") -> DataFrame:
    """All series side by side on the union of their dates, for a sink that wants it wide."""
    return df.groupBy(t).pivot(key, values).agg(F.first(value, ignorenulls=True))


def concat_panels(a: DataFrame, b: DataFrame, on: str = "t") -> DataFrame:
    return a.join(b, on, "full_outer")


def common_dates(a: DataFrame, b: DataFrame, on: str | list[str] = "t") -> DataFrame:
    return a.join(b, on)


def common_trading(a: DataFrame, b: DataFrame, flagged: DataFrame, flag: str = "trading_day",
                   on: str = "t") -> DataFrame:
    """Dates in both panels where the flag table says the market was open."""
    days = flagged.filter(F.col(flag) == 1).select(on)
    return a.join(b, on).join(days, on)


def reindex(df: DataFrame, s: Series, calendar: DataFrame) -> DataFrame:
    """Exactly the calendar's times for every series; rows at other times are dropped.

    The calendar's own distinct times are packed by bucket, a bounded number each. Every series
    unfolds to the buckets of the calendar's span, meets the packed times by equality and unfolds
    them, so any spacing is kept and no row meets all others.
    """
    packed = (calendar.select(s.t).distinct().withColumn(BUCKET, bucket_of(calendar, s))
              .groupBy(BUCKET).agg(F.collect_list(s.t).alias("_times")))
    span = packed.agg(F.min(BUCKET).alias("lo"), F.max(BUCKET).alias("hi"))
    buckets = (df.select(*s.keys).distinct()
               .withColumns({"_lo": span.select("lo").scalar(), "_hi": span.select("hi").scalar()})
               .select(*s.keys, F.explode(F.expr(f"sequence(_lo, _hi, {bucket_step(calendar, s)})")).alias(BUCKET)))
    grid = buckets.join(packed, BUCKET).select(*s.keys, F.explode("_times").alias(s.t))
    return grid.join(df, [*s.keys, s.t], "left")


def min_history(df: DataFrame, s: Series, bound) -> DataFrame:
    """Series whose first date is not after `bound`."""
    first = df.groupBy(*s.keys).agg(F.min(s.t).alias("_first"))
    return df.join(first.filter(F.col("_first") <= F.lit(bound)), s.keys, "left_semi")


def short_history(df: DataFrame, s: Series, bound) -> DataFrame:
    """The series `min_history` leaves out, with their first dates."""
    first = df.groupBy(*s.keys).agg(F.min(s.t).alias("first_t"))
    return first.filter(F.col("first_t") > F.lit(bound))


def cutoff(df: DataFrame, t: str, day) -> DataFrame:
    return df.filter(F.col(t) < F.lit(day))


def count_between(points: DataFrame, spans: DataFrame, s: Series,
                  name: str = "n_points") -> DataFrame:
    """Points in [t, next t) for each span start; the last span reaches to the end.

    Points are counted per time first. Spans and points then share one ordered relation, where
    each point takes the last span start at or before it: linear, no range join.
    """
    one = F.lit(1)
    both = (spans.select(*s.keys, s.t).withColumns({"_span": one, "_n": F.lit(0)})
            .unionByName(points.groupBy(*s.keys, s.t).agg(F.count(one).alias("_n"))
                         .withColumn("_span", F.lit(0))))
    both = both.groupBy(*s.keys, s.t).agg(F.max("_span").alias("_span"), F.sum("_n").alias("_n"))
    start = F.when(F.col("_span") == 1, F.col(s.t))
    last = Running({"_mx": F.max(start)}, {"_prev": Carry("_mx", "max")},
                   {"_start": F.coalesce(F.max(start).over(so_far(s)), F.col("_prev"))})
    return (running(both, s, last).filter(F.col("_start").isNotNull())
            .groupBy(*s.keys, F.col("_start").alias(s.t)).agg(F.sum("_n").alias(name)))


def reconcile(ours: DataFrame, vendor: DataFrame, mapping: DataFrame, t: str = "t",
              value: str = "close", tolerance: float = 0.02) -> DataFrame:
    """Own series against a vendor's, after the unit factor.

    `mapping(id, vendor_ticker, factor)`. Ids without a vendor stay, alone. Each row says whether
    a side is missing, and how far apart the two are.
    """
    mine = (ours.select("id", t, F.col(value).alias("ours"))
            .join(mapping, "id", "left")
            .withColumn("ours", F.col("ours") * F.coalesce("factor", F.lit(1.0)))
            .withColumn("mapped", F.col("vendor_ticker").isNotNull())
            .select("id", t, "ours", "mapped"))
    theirs = (vendor.join(mapping, vendor["ticker"] == mapping["vendor_ticker"])
              .select(mapping["id"], vendor[t], vendor[value].alias("vendor")))
    both = mine.join(theirs, ["id", t], "full_outer")
    gap = F.col("ours") - F.col("vendor")
    return both.withColumns({
        "mapped": F.coalesce("mapped", F.lit(True)),
        "abs_dev": F.abs(gap),
        "rel_dev": F.when(F.col("vendor") != 0, F.abs(gap / F.col("vendor"))),
    }).withColumns({
        "missing": F.when(F.col("ours").isNull(), "ours")
                    .when(F.col("vendor").isNull() & F.col("mapped"), "vendor"),
        "off": F.coalesce(F.col("rel_dev") > tolerance, F.lit(False)),
    })


def column_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, column): columns that only one of two tables has."""
    rows = [("only_a", c) for c in a.columns if c not in b.columns]
    rows += [("only_b", c) for c in b.columns if c not in a.columns]
    return a.sparkSession.createDataFrame(rows, "side string, column string")


def row_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only one of two tables has, duplicates counted.

    Rows of `a` count up and rows of `b` down, once for both sides. They are dealt out before they are
    counted, TASK_ROWS a task, so that none holds all rows of an input file's split; copies
    are first counted apart by where they came from, so that a row with many copies is no one task's work.
    """
    cols = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    both = both.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // TASK_ROWS))
    for by in ([*cols, "_salt"], cols):
        both = both.repartition(tasks, *[F.col(f"`{c}`") for c in by]).groupBy(
            *[F.col(f"`{c}`") for c in by]).agg(F.sum("_n").alias("_n"))
    left = both.filter("_n <> 0").withColumn("side", F.when(F.col("_n") > 0, "only_a").otherwise("only_b"))
    # copies unfold in two steps, so that no array is as long as their number
    left = left.withColumns({"_n": F.abs("_n"), "_k": F.explode(F.expr(f"sequence(0L, (abs(_n) - 1) div {COPIES})"))})
    left = left.withColumn("_c", F.explode(F.expr(f"sequence(1L, least({COPIES}L, _n - _k * {COPIES}))")))
    return left.select(*[F.col(f"`{c}`") for c in cols], "side")


def to_unit(df: DataFrame, factors: DataFrame, value: str = "close",
            key: str = "id") -> DataFrame:
    """Convert by a per-series factor; series without one keep their unit."""
    return (df.join(factors.select(key, F.col("factor").alias("_f")), key, "left")
            .withColumn(value, F.col(value) * F.coalesce("_f", F.lit(1.0))).drop("_f"))


def positive_only(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.filter(F.col(c) > 0)
    return df


def suspicious_rows(df: DataFrame, t: str = "t", prices=("open", "high", "low", "close"),
                    volume: str = "volume") -> DataFrame:
    """Weekend rows, non-positive prices and zero volume, flagged; clean rows are left out."""
    bad_price = F.lit(False)
    for c in prices:
        bad_price = bad_price | F.coalesce(F.col(c) <= 0, F.lit(False))
    out = df.withColumns({
        "weekend": F.weekday(t) >= 5, "bad_price": bad_price,
        "zero_volume": F.coalesce(F.col(volume) == 0, F.lit(False))})
    return out.filter("weekend or bad_price or zero_volume")


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ingest order.

    `max_by` over the whole row combines map-side, so copies of one key never meet unreduced.
    """
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of any key that occurs more than once."""
    many = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1"))
    return df.join(many, keys)


def union_series(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def encode_label(c) -> Column:
    """negative, neutral, positive as -1, 0, 1."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "positive", 1).when(c == "negative", -1).when(c == "neutral", 0)


def sanitize(c) -> Column:
    """A name that is safe as a file name."""
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")
