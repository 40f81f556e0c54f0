"""Technical indicators over bars. Every frame counts rows, not calendar time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelspark.functions.calendar import calendar_features
from panelspark.operators.segments import (
    ROW, SEGMENT_ROWS, Carry, Running, by_bucket, fills, full_frame, lagged_products, number_rows, rolled,
    row_numbers, running, series_totals, so_far, state_after, states_before, sums, when_full)
from panelspark.schema import Series
from panelspark.session import stage


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ── expressions on an ordered window ────────────────────────────────────────
def lag1(x, w: WindowSpec) -> Column:
    return F.lag(_c(x), 1).over(w)


def movement(open_, close, w: WindowSpec) -> Column:
    """Gap of the open against the previous close, as a fraction."""
    prev = lag1(close, w)
    return F.when(prev != 0, (_c(open_) - prev) / prev)


def roc(x, w: WindowSpec, p: int = 10) -> Column:
    """Change over p rows, in percent."""
    prev = F.lag(_c(x), p).over(w)
    return F.when(prev != 0, (_c(x) / prev - 1) * 100)


def daily_return(x, w: WindowSpec) -> Column:
    """Change over one row, in percent."""
    return roc(x, w, 1)


def volatility(ret, w: WindowSpec, n: int = 5) -> Column:
    """Sample deviation of the last n returns."""
    return when_full(F.stddev_samp(_c(ret)), _c(ret), w, n)


def rolling_mean(x, w: WindowSpec, n: int = 60) -> Column:
    return when_full(F.avg(_c(x)), _c(x), w, n)


def rsi(delta, w: WindowSpec, n: int = 14) -> Column:
    """Relative strength from plain means of gains and losses; 100 when nothing was lost.

    100 - 100 / (1 + up / down) is 100 * up / (up + down), and up + down is the mean of |delta|.
    Each window aggregate is used once: a repeated one would be computed again.
    """
    d, f = _c(delta), full_frame(w, n)
    up = F.avg(F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))).over(f)
    either = F.avg(F.abs(d)).over(f)
    return F.when(F.count(d).over(f) == n, F.coalesce(F.try_divide(100 * up, either), F.lit(100.0)))


def _in_range(high, low, x: Column, w: WindowSpec, n: int) -> Column:
    """x over the width of the high-low range of n rows; null for an empty range or short frame."""
    f = full_frame(w, n)
    width = F.max(_c(high)).over(f) - F.min(_c(low)).over(f)
    return F.when(F.count(_c(high) + _c(low)).over(f) == n, F.try_divide(x, width))


def stochastic_k(high, low, close, w: WindowSpec, n: int = 14) -> Column:
    """Close within the high-low range of n rows, 0 to 100; null for an empty range."""
    return _in_range(high, low, 100 * (_c(close) - F.min(_c(low)).over(full_frame(w, n))), w, n)


def williams_r(high, low, close, w: WindowSpec, n: int = 14) -> Column:
    """Distance of the close from the top of the range, -100 to 0; null for an empty range."""
    return _in_range(high, low, -100 * (F.max(_c(high)).over(full_frame(w, n)) - _c(close)), w, n)


def _ema_maps(x: Column, span: float, gap: Column | None = None, first: Column | None = None) -> tuple[Column, Column]:
    """An exponential mean as an affine recurrence: weight 2/(span+1) on the newest value, seeded with the first.

    A value g rows after the last one counts weight / (d^g + weight), the mean so far the rest.
    """
    weight = 2 / (span + 1)
    if gap is None:
        return F.lit(1 - weight), F.when(first, x).otherwise(x * weight)
    old = F.pow(F.lit(max(1 - weight, 0.0)), gap)
    kept = F.coalesce(old / (old + weight), F.lit(0.0))
    return kept, x * (1 - kept)


# ── the enrichment bundle ───────────────────────────────────────────────────
INDICATORS = ["Movement", "Daily_Return", "Volatility", "EMA_12", "EMA_26", "MACD", "RSI",
              "Stoch_K", "Stoch_D", "Williams_R", "ROC"]


def enrich(df: DataFrame, s: Series, open_="open", high="high", low="low", close="close",
           vol_n: int = 5, fast: int = 12, slow: int = 26, rsi_n: int = 14, k_n: int = 14,
           d_n: int = 3, roc_n: int = 10, drop_nulls: bool = True,
           size: int = SEGMENT_ROWS) -> DataFrame:
    """Fill, then every indicator and the calendar encodings, then drop incomplete rows.

    All indicators share one exchange and one sort. The filled rows are written once, for they are read
    twice: by the exponential means, whose states before each segment go beside it, and by the rest.
    """
    price = [open_, high, low, close]
    df = stage(running(df.withColumns({c: F.col(c).cast("double") for c in price}), s,
                       row_numbers(s), fills(s, price)), "filled")
    back = max(rsi_n + 1, k_n + d_n, roc_n, vol_n + 1)
    maps = {f"EMA_{n}": _ema_maps(F.col(close), n, first=F.col(ROW) == 1) for n in (fast, slow)}
    means = states_before(df, s, maps, size)

    def steps(w):
        # one column per distinct frame aggregate, then arithmetic on the columns; after the fill
        # a frame is full when enough rows precede, except where a return divides by zero
        top, bottom, width = F.col("_hi"), F.col("_lo"), F.col("_hi") - F.col("_lo")
        full = F.col(ROW) >= k_n
        frame = full_frame(w, rsi_n)
        strength = F.try_divide(100 * F.avg(F.greatest("_delta", F.lit(0.0))).over(frame),
                                F.avg(F.abs("_delta")).over(frame))
        return [
            {
                "_prev": lag1(close, w),
                "_hi": F.max(high).over(full_frame(w, k_n)),
                "_lo": F.min(low).over(full_frame(w, k_n)),
                **{n: state_after(s, n, *ab, size) for n, ab in maps.items()},
                "ROC": roc(close, w, roc_n),
            },
            {
                "Movement": F.try_divide(F.col(open_) - F.col("_prev"), F.col("_prev")),
                "Daily_Return": (F.try_divide(F.col(close), F.col("_prev")) - 1) * 100,
                "_delta": F.col(close) - F.col("_prev"),
                "MACD": F.col(f"EMA_{fast}") - F.col(f"EMA_{slow}"),
                "Stoch_K": F.when(full, F.try_divide(100 * (F.col(close) - bottom), width)),
                "Williams_R": F.when(full, F.try_divide(-100 * (top - F.col(close)), width)),
            },
            {
                "Volatility": volatility("Daily_Return", w, vol_n),
                "RSI": F.when((F.col(ROW) > rsi_n) & F.col("_delta").isNotNull(),
                              F.coalesce(strength, F.lit(100.0))),
                "Stoch_D": rolling_mean("Stoch_K", w, d_n),
            },
        ]

    out = rolled(df, s, steps, back=back, size=size, beside=means).drop("_prev", "_hi", "_lo", "_delta")
    out = out.withColumns(calendar_features(s.t))
    return out.dropna("any") if drop_nulls else out


def indicator(df: DataFrame, s: Series, name: str, expr, back: int,
              size: int = SEGMENT_ROWS) -> DataFrame:
    """One column from `expr(w)` with `back` rows of history."""
    return rolled(df, s, lambda w: {name: expr(w)}, back=back, size=size)


def add_emas(df: DataFrame, s: Series, col: str, spans: dict[str, float],
             size: int = SEGMENT_ROWS) -> DataFrame:
    """Exponential means that start at the first value and hold over nulls, whose rows still age them.

    Every row counts, however far back: rows are affine maps of the mean so far, composed by
    segments. The input is read several times: pass a table, or `stage` it first, and give all spans at once.
    """
    numbered = number_rows(df, s, "_pos").withColumn("_x", F.col(col).cast("double"))
    known = numbered.filter(F.col("_x").isNotNull())
    w = by_bucket(s)
    before = Running({"_last": F.max("_pos")}, {"_far": Carry("_last", "max")},
                     {"_gap": F.col("_pos") - F.coalesce(F.lag("_pos", 1).over(w), F.col("_far"))})
    known = stage(running(known, s, row_numbers(s), before), "known")
    maps = {n: _ema_maps(F.col("_x"), span, F.col("_gap")) for n, span in spans.items()}
    out = rolled(known, s, lambda _: {n: state_after(s, n, *ab, size) for n, ab in maps.items()}, size=size,
                 beside=states_before(known, s, maps, size))
    every = out.drop("_gap").unionByName(numbered.filter(F.col("_x").isNull()), allowMissingColumns=True)
    held = running(every, s, *[_hold(s, n) for n in spans])
    return held.drop("_pos", "_x")


def _hold(s: Series, col: str) -> Running:
    """The last seen value."""
    seen = F.when(F.col(col).isNotNull(), F.col(s.t))
    return Running({f"_l_{col}": F.max_by(col, seen)},
                   {f"_in_{col}": Carry(f"_l_{col}", "last")},
                   {col: F.coalesce(F.last(col, ignorenulls=True).over(so_far(s)), F.col(f"_in_{col}"))})


def add_ema(df: DataFrame, s: Series, col: str, span: float, name: str | None = None,
            size: int = SEGMENT_ROWS) -> DataFrame:
    return add_emas(df, s, col, {name or f"EMA_{span}": span}, size)


def add_macd(df: DataFrame, s: Series, col: str, fast: int = 12, slow: int = 26,
             size: int = SEGMENT_ROWS) -> DataFrame:
    out = add_emas(df, s, col, {"_fast": fast, "_slow": slow}, size)
    return out.withColumn("MACD", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")


def add_rsi(df: DataFrame, s: Series, col: str, n: int = 14) -> DataFrame:
    return rolled(df, s, lambda w: [{"_delta": F.col(col) - lag1(col, w)},
                                    {"RSI": rsi("_delta", w, n)}], back=n).drop("_delta")


def add_stochastic(df: DataFrame, s: Series, high="high", low="low", close="close", n: int = 14,
                   smooth: int = 3) -> DataFrame:
    return rolled(df, s, lambda w: [{"Stoch_K": stochastic_k(high, low, close, w, n)},
                                    {"Stoch_D": rolling_mean("Stoch_K", w, smooth)}],
                  back=n + smooth)


def add_volatility(df: DataFrame, s: Series, col: str, n: int = 5) -> DataFrame:
    return rolled(df, s, lambda w: [{"_ret": daily_return(col, w)},
                                    {"Volatility": volatility("_ret", w, n)}],
                  back=n + 1).drop("_ret")


def direction(df: DataFrame, s: Series, col: str, name: str = "direction") -> DataFrame:
    """Sign of the first difference; the first row of a series has none and is dropped."""
    out = rolled(df, s, lambda w: {name: F.signum(F.col(col) - lag1(col, w)).cast("int")}, back=1)
    return out.filter(F.col(name).isNotNull())


# ── running state ───────────────────────────────────────────────────────────
def running_sum(df: DataFrame, s: Series, col: str, name: str) -> DataFrame:
    """Cumulative sum along the series."""
    return running(df, s, sums(s, col, name))


def running_product(df: DataFrame, s: Series, col: Column, name: str) -> DataFrame:
    """Cumulative product, exact in sign: log magnitudes are summed, signs and zeros counted."""
    out = df.withColumns({
        "_ln": F.when(col != 0, F.ln(F.abs(col))).otherwise(F.when(col == 0, F.lit(0.0))),
        "_neg": (col < 0).cast("int"), "_zero": (col == 0).cast("int")})
    out = running(out, s, *[sums(s, c, f"_run{c}") for c in ("_ln", "_neg", "_zero")])
    sign = F.when(F.col("_run_neg") % 2 == 1, -1.0).otherwise(1.0)
    value = F.when(F.col("_run_zero") > 0, 0.0).otherwise(F.exp("_run_ln") * sign)
    return out.withColumn(name, value).drop("_ln", "_neg", "_zero", "_run_ln", "_run_neg",
                                            "_run_zero")


def cum_return(df: DataFrame, s: Series, ret: str, name: str = "cum_return") -> DataFrame:
    """Growth of one unit along the returns; a missing return counts as none."""
    return running_product(df, s, 1 + F.coalesce(F.col(ret), F.lit(0.0)), name)


def first_valid(s: Series, col: str, name: str) -> Running:
    """First non-null value of the series."""
    seen = F.when(F.col(col).isNotNull(), F.col(s.t))
    return Running({f"_fv_{name}": F.min_by(col, seen)}, {name: Carry(f"_fv_{name}", "first", "all")})


def normalise_first(df: DataFrame, s: Series, col: str, name: str) -> DataFrame:
    """Each series divided by its first valid value."""
    out = running(df, s, first_valid(s, col, "_first"), Running({}, {}, {
        name: F.when(F.col("_first") != 0, F.col(col) / F.col("_first"))}))
    return out


# ── differencing ────────────────────────────────────────────────────────────
def all_positive(s: Series, col: str, name: str) -> Running:
    """Whether the whole column of the series is positive."""
    return Running({f"_min_{name}": F.min(col)}, {name: Carry(f"_min_{name}", "min", "all", lambda c: c > 0)})


def difference(df: DataFrame, s: Series, cols: list[str],
               mode: str | dict[str, str] = "log_diff") -> DataFrame:
    """`no_diff`, `diff` or `log_diff`, in place; one mode for all columns, or one per column.

    The log is used for a column of a series only when the whole column is positive there. The
    first row, which has no predecessor, takes the value of the second.
    """
    modes = {c: mode if isinstance(mode, str) else mode[c] for c in cols}
    for m in modes.values():
        if m not in ("no_diff", "diff", "log_diff"):
            raise ValueError(f"unknown differencing mode {m!r}")
    cols = [c for c in cols if modes[c] != "no_diff"]
    if not cols:
        return df
    log = [c for c in cols if modes[c] == "log_diff"]
    df = running(df, s, row_numbers(s), *[all_positive(s, c, f"log_{c}") for c in log])

    def value(c):
        x = F.col(c).cast("double")
        return F.when(F.col(f"log_{c}"), F.ln(x)).otherwise(x) if c in log else x

    def steps(w):
        diff = {f"_d_{c}": value(c) - F.lag(value(c), 1).over(w) for c in cols}
        fill = {c: F.coalesce(F.col(f"_d_{c}"), F.when(F.col(ROW) == 1, F.lead(f"_d_{c}", 1).over(w)))
                for c in cols}
        return [diff, fill]

    out = rolled(df, s, steps, back=1, ahead=1)
    return out.drop(*[f"_d_{c}" for c in cols], *[f"log_{c}" for c in log])


def invert_difference(df: DataFrame, s: Series, col: str, anchor: str, mode: str,
                      name: str = "level") -> DataFrame:
    """Levels from differences: anchor + running sum, or anchor * exp(running sum)."""
    if mode == "no_diff":
        return df.withColumn(name, F.col(col))
    out = running_sum(df, s, col, "_sum")
    level = (F.col(anchor) * F.exp("_sum") if mode == "log_diff"
             else F.col(anchor) + F.col("_sum"))
    return out.withColumn(name, level).drop("_sum")


# ── whole-series views ──────────────────────────────────────────────────────
def first_dates(df: DataFrame, s: Series) -> DataFrame:
    """First date of each series and the year it starts in."""
    return (df.groupBy(*s.keys).agg(F.min(s.t).alias("first_t"))
            .withColumn("year", F.year("first_t")))


def late_starters(df: DataFrame, s: Series, bound) -> DataFrame:
    """Series that start after `bound`, one row each, with the number that start the same year.

    The list stays long: a year may hold any number of series.
    """
    late = first_dates(df, s).filter(F.col("first_t") > F.lit(bound))
    per_year = late.groupBy("year").agg(F.count(F.lit(1)).alias("n_in_year"))
    return late.join(per_year, "year")


def acf(df: DataFrame, s: Series, col: str, lags: list[int]) -> DataFrame:
    """Autocorrelation at the given lags with the 1.96/sqrt(n) band.

    Rows get their number and the mean of their series in one pass, are centred, and meet the rows
    `lag` positions before in overlapping segments. A constant series has the value null; a lag without
    a pair of rows is left out.
    """
    x = df.filter(F.col(col).isNotNull()).select(*s.keys, s.t, F.col(col).alias("_x"))
    x = running(x, s, row_numbers(s), series_totals(s, "_x", "x"))
    x = x.withColumn("_c", F.col("_x") - F.col("x_mean"))
    x = x.withColumn("_varies", F.col("x_min") < F.col("x_max")).withColumnRenamed("x_count", "n")
    sums = lagged_products(x, s, "_c", sorted({0, *lags}), ["n", "_varies"])
    per = sums.groupBy(*s.keys).agg(F.first("n").alias("n"), F.first("_varies").alias("_varies"),
                                    F.map_from_entries(F.collect_list(F.struct("lag", "total"))).alias("_by"))
    out = per.withColumn("lag", F.explode(F.array(*[F.lit(int(k)) for k in lags]))).filter(F.col("lag") < F.col("n"))
    return out.select(*s.keys, "lag", "n", F.when(F.col("_varies"), F.col("_by")[F.col("lag")] / F.col("_by")[0]).alias("acf"),
                      (1.96 / F.sqrt(F.col("n"))).alias("band"))
