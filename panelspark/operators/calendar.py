"""Calendars, gap filling and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.segments import (
    Carry, Running, fills, from_here, rolled, running, so_far, sums)
from panelspark.schema import PROB_COLS, PROB_LABELS, Series


def calendar(spark, start, end, t: str = "t") -> DataFrame:
    """Every day from start to end."""
    return spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))).alias(t))


def days_between(df: DataFrame, t: str, start: Column | None = None,
                 end: Column | None = None) -> DataFrame:
    """Every day between the first and last `t` of df (one row of bounds is exploded)."""
    lo, hi = start if start is not None else F.min(t), end if end is not None else F.max(t)
    return (df.agg(lo.alias("_lo"), hi.alias("_hi"))
            .filter(F.col("_lo").isNotNull())
            .select(F.explode(F.expr("sequence(_lo, _hi, interval 1 day)")).alias(t)))


def series_days(df: DataFrame, s: Series) -> DataFrame:
    """Every day of the span of the whole table, for each series; `t` must be a date.

    Bounds are a scalar subquery, so no row of one side meets every row of the other. For another
    spacing, `reindex` takes the times themselves.
    """
    if dict(df.dtypes)[s.t] != "date":
        raise TypeError(f"{s.t}: days need a date; use reindex with a calendar of times")
    bounds = df.agg(F.min(s.t).alias("lo"), F.max(s.t).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    return (df.select(*s.keys).distinct().withColumns({"_lo": lo, "_hi": hi})
            .select(*s.keys, F.explode(F.expr("sequence(_lo, _hi, interval 1 day)")).alias(s.t)))


def shared_calendar(target: DataFrame, news: DataFrame | None, t: str = "t",
                    close: str = "close", prob: str | None = "prob_positive",
                    cutoff=None) -> DataFrame:
    """Days within the trading span with an open market or published news, before `cutoff`.

    News counts where its probability is present; without a probability column the mere row
    counts. Both inputs are reduced to distinct days first.
    """
    trading = target.filter(F.col(close).isNotNull()).select(t).distinct()
    days = trading
    if news is not None:
        if prob and prob in news.columns:
            news = news.filter(F.col(prob).isNotNull())
        span = trading.agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
        inside = news.select(t).distinct().filter(
            F.col(t).between(span.select("lo").scalar(), span.select("hi").scalar()))
        days = trading.union(inside).distinct()
    return days.filter(F.col(t) < F.lit(cutoff)) if cutoff is not None else days


def ffill_bfill(df: DataFrame, s: Series, cols: list[str]) -> DataFrame:
    """Last seen value, else the next one."""
    return running(df, s, fills(s, cols))


def _time_number(df: DataFrame, s: Series) -> Column:
    if dict(df.dtypes)[s.t] == "date":
        return F.unix_date(s.t).cast("double")
    if dict(df.dtypes)[s.t].startswith("timestamp"):
        return F.unix_micros(F.col(s.t).cast("timestamp")).cast("double")
    return F.col(s.t).cast("double")


def interpolate_time(df: DataFrame, s: Series, cols: list[str], edges: bool = True,
                     whole_rows: bool = False) -> DataFrame:
    """Linear in calendar distance between the neighbours that have a value.

    With `edges` a leading gap takes the first value and a trailing gap the last. `whole_rows`
    says that the columns are present or missing together (as after a reindex of complete rows):
    one search for neighbours then serves all of them.
    """
    df = df.withColumn("_u", _time_number(df, s))
    groups = [list(cols)] if whole_rows else [[c] for c in cols]
    back, fore = so_far(s), from_here(s)
    parts, state, ends, value, scratch = {}, {}, {}, {}, ["_u"]
    for i, group in enumerate(groups):
        there = F.col(group[0]).isNotNull()
        known, prev, after = f"_k{i}", f"_p{i}", f"_n{i}"
        df = df.withColumn(known, F.when(there, F.struct(F.col("_u").alias("u"), *group)))
        parts[f"_l{i}"], parts[f"_f{i}"] = F.max_by(known, known + ".u"), F.min_by(known, known + ".u")
        state[f"_in{i}"] = Carry(f"_l{i}", "last")
        state[f"_out{i}"] = Carry(f"_f{i}", "first", "after")
        ends[prev] = F.coalesce(F.last(known, ignorenulls=True).over(back), F.col(f"_in{i}"))
        ends[after] = F.coalesce(F.last(known, ignorenulls=True).over(fore), F.col(f"_out{i}"))
        scratch += [known, prev, after]
        p, n = F.col(prev), F.col(after)
        share = (F.col("_u") - p["u"]) / (n["u"] - p["u"])
        for c in group:
            line = F.when(p.isNotNull() & n.isNotNull(), p[c] + (n[c] - p[c]) * share)
            value[c] = F.when(there, F.col(c)).otherwise(F.coalesce(line, p[c], n[c]) if edges else line)
    out = running(df, s, Running(parts, state, ends))
    return out.withColumns(value).drop(*scratch)


def first_max_label(probs: list[Column], labels=PROB_LABELS) -> Column:
    """Label of the largest probability; the first of equal ones wins. Null if all are null."""
    top = F.greatest(*probs)
    out = F.when(probs[0] == top, F.lit(labels[0]))
    for p, name in zip(probs[1:], labels[1:]):
        out = out.when(p == top, F.lit(name))
    return out


def mean_vector(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def fill_isolated(news: DataFrame, t: str = "t", probs=PROB_COLS, labels=PROB_LABELS,
                  vector: str | None = "embedding", label: str = "label") -> DataFrame:
    """Add the days whose two neighbours have news and which have none: the mean of both.

    Longer gaps stay. Each day announces itself to the following and the preceding day, so the
    neighbours meet by an aggregate on the day; no calendar is needed. A table without
    probability columns comes back unchanged, one without the vector column is filled without it;
    other columns are kept and null on the added days.
    """
    vector = vector if vector in news.columns else None
    if not set(probs) <= set(news.columns):
        return news
    real = news.filter(F.col(probs[0]).isNotNull())
    body = F.struct(*probs, *([vector] if vector else []))
    told = real.select(F.explode(F.array(
        F.struct(F.col(t).alias("day"), F.lit(0).alias("who")),
        F.struct(F.date_add(t, 1).alias("day"), F.lit(-1).alias("who")),
        F.struct(F.date_sub(t, 1).alias("day"), F.lit(1).alias("who")))).alias("m"),
        body.alias("b"))
    met = told.groupBy(F.col("m.day").alias(t)).agg(
        F.max(F.when(F.col("m.who") == 0, 1)).alias("here"),
        F.first(F.when(F.col("m.who") == -1, F.col("b")), ignorenulls=True).alias("p"),
        F.first(F.when(F.col("m.who") == 1, F.col("b")), ignorenulls=True).alias("n"))
    hole = met.filter("here is null and p is not null and n is not null")
    cols = {c: (F.col(f"p.{c}") + F.col(f"n.{c}")) / 2 for c in probs}
    if vector:
        cols[vector] = mean_vector(F.col(f"p.{vector}"), F.col(f"n.{vector}"))
    filled = hole.select(t, *[e.alias(c) for c, e in cols.items()])
    filled = filled.withColumn(label, first_max_label([F.col(c) for c in probs], labels))
    return real.unionByName(filled, allowMissingColumns=True)


def zero_vector(dim: int | Column) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def dense_vectors(df: DataFrame, col: str) -> DataFrame:
    """Zero vectors where none is present, as wide as the widest real one."""
    dim = df.agg(F.max(F.size(col))).scalar()
    return df.withColumn(col, F.coalesce(F.col(col).cast("array<double>"), zero_vector(dim)))


def zero_vectors(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """The template used when news is switched off: zeros on every row."""
    return df.withColumn(col, zero_vector(F.lit(dim)))


def date_gaps(df: DataFrame, s: Series, n: int) -> DataFrame:
    """Consecutive rows more than n days apart."""
    out = rolled(df.select(*s.keys, s.t), s, lambda w: {"prev_t": F.lag(s.t, 1).over(w)}, back=1)
    out = out.withColumn("gap_days", F.datediff(s.t, "prev_t"))
    return out.filter(F.col("gap_days") > n)


def coverage_gaps(df: DataFrame, t: str, flag: str) -> DataFrame:
    """Rows where the flag is 0, told apart: an isolated empty day, or the trailing end.

    The last covered day is one scalar, compared against every row.
    """
    last = df.filter(F.col(flag) > 0).agg(F.max(t)).scalar()
    out = df.filter(F.col(flag) == 0).withColumn("last_covered", last)
    return out.withColumn("kind", F.when(F.col(t) > F.col("last_covered"), F.lit("trailing"))
                          .otherwise(F.lit("isolated")))


def empty_runs(df: DataFrame, s: Series, flag: str) -> DataFrame:
    """Runs of consecutive rows with flag 0: first, last, length.

    A run is the rows that share the count of covered rows before them.
    """
    covered = df.select(*s.keys, s.t, flag).withColumn("_c", (F.col(flag) > 0).cast("int"))
    runs = running(covered, s, sums(s, "_c", "_run"))
    return (runs.filter(F.col(flag) == 0).groupBy(*s.keys, "_run")
            .agg(F.min(s.t).alias("first_t"), F.max(s.t).alias("last_t"),
                 F.count(F.lit(1)).alias("n_rows")).drop("_run"))


def trading_day(df: DataFrame, close: str = "close", name: str = "trading_day") -> DataFrame:
    return df.withColumn(name, F.col(close).isNotNull().cast("int"))
