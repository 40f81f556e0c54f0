"""Splits, sliding windows, scales, tokens and the persistence baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.align import row_diff
from panelspark.operators.segments import ROW, in_segment, number_rows, own_rows, segmented
from panelspark.schema import Series

# Defaults of the forecast set-up.
CTX_LEN, PRED_LEN, TEST_ROWS, VAL_ROWS = 150, 7, 250, 250
LOW, HIGH, N_TOKENS, N_SPECIAL = -15.0, 15.0, 4096, 2


def temporal_split(df: DataFrame, s: Series, test: int = TEST_ROWS, val: int = VAL_ROWS,
                   ctx: int = CTX_LEN) -> DataFrame:
    """Split by row count from the end: test is the last `test` rows, val the `val` before it,
    train the rest.

    Validation and test also get the `ctx` rows before them, so a row near a border appears once
    per split it belongs to. Adds `split`, and the row's position in it, which windows over
    (series, split) use as they are.
    """
    out = number_rows(df, s, ROW, "series_len")
    pos, n = F.col(ROW) - 1, F.col("series_len")
    test_at = F.greatest(n - test, F.lit(0))
    val_at = F.greatest(test_at - val, F.lit(0))
    names = F.array_compact(F.array(
        F.when(pos < val_at, F.lit("train")),
        F.when((pos >= F.greatest(val_at - ctx, F.lit(0))) & (pos < test_at), F.lit("val")),
        F.when(pos >= F.greatest(test_at - ctx, F.lit(0)), F.lit("test"))))
    out = out.withColumn("split", F.explode(names))
    starts = {"train": F.lit(0), "val": F.greatest(val_at - ctx, F.lit(0)),
              "test": F.greatest(test_at - ctx, F.lit(0))}
    start = F.coalesce(*[F.when(F.col("split") == k, v) for k, v in starts.items()])
    return out.withColumn(ROW, F.col(ROW) - start).drop("series_len")


def sliding_windows(df: DataFrame, s: Series, ctx: int = CTX_LEN, pred: int = PRED_LEN,
                    target: str = "close", cols: list[str] | None = None,
                    ahead: list[str] | None = None, size: int | None = None) -> DataFrame:
    """Every stride-1 window: `ctx` rows of context and the `pred` target rows after them.

    One row per window: `window` (1-based), `start_t` the first forecast time, `x` and `y` the
    target's context and future, for each column in `cols` (scalar, vector or struct) the context
    array `x_{col}`, and for each in `ahead` the future array `y_{col}`. `scale` is the mean
    absolute target of the context (1 when zero or undefined), a window aggregate. Windows are cut inside segments that overlap by ctx + pred rows;
    prune columns first, the output is that much larger than the input.
    """
    cols, ahead = cols or [], ahead or []
    size = size or max(512, 4 * (ctx + pred))
    keep = df.select(*s.keys, s.t, *dict.fromkeys([target, *cols, *ahead]),
                     *([ROW] if ROW in df.columns else []))
    seg = segmented(keep, s, back=ctx, ahead=pred - 1, size=size)
    w = in_segment(s)
    past, future = w.rowsBetween(-ctx, -1), w.rowsBetween(0, pred - 1)

    def pack(c):
        # nulls stay in place: a struct is never null, so collect_list keeps its position
        return F.struct(F.col(c).alias("v"))
    out = seg.withColumns({
        "_scale": F.avg(F.abs(F.col(target).cast("double"))).over(past),
        "x": F.collect_list(pack(target)).over(past), "y": F.collect_list(pack(target)).over(future),
        **{f"x_{c}": F.collect_list(pack(c)).over(past) for c in cols},
        **{f"y_{c}": F.collect_list(pack(c)).over(future) for c in ahead}})
    out = own_rows(out).filter((F.size("x") == ctx) & (F.size("y") == pred))
    arrays = ["x", "y", *[f"x_{c}" for c in cols], *[f"y_{c}" for c in ahead]]
    m = F.col("_scale")
    return out.select(*s.keys, (F.col(ROW) - ctx).alias("window"), F.col(s.t).alias("start_t"),
                      F.when(m > 0, m).otherwise(F.lit(1.0)).alias("scale"),
                      *[F.transform(a, lambda v: v["v"]).alias(a) for a in arrays])


def assert_aligned(a: DataFrame, b: DataFrame, on: list[str]) -> None:
    """Raise unless both tables have exactly the same keys."""
    ka, kb = a.select(*on), b.select(*on)
    if row_diff(ka, kb).limit(1).count():
        raise ValueError(f"streams are not aligned on {on}")


def array_mean(a, f) -> Column:
    """Mean of f(x) over the non-null elements of an array."""
    real = F.filter(a, lambda v: v.isNotNull())
    total = F.aggregate(real, F.lit(0.0), lambda acc, v: acc + f(v))
    return F.when(F.size(real) > 0, total / F.size(real))


def window_scale(x="x") -> Column:
    """Mean absolute value of the context; 1 when undefined or zero."""
    m = array_mean(x, lambda v: F.abs(v.cast("double")))
    return F.when(m > 0, m).otherwise(F.lit(1.0))


def global_scale(train: DataFrame, s: Series, col: str) -> DataFrame:
    """Mean absolute value of each series over its training rows."""
    m = F.avg(F.abs(F.col(col).cast("double")))
    return train.groupBy(*s.keys).agg(F.when(m > 0, m).otherwise(F.lit(1.0)).alias("scale"))


def _step(lo: float, hi: float, n_tokens: int, n_special: int) -> float:
    return (hi - lo) / (n_tokens - n_special - 2)


def token(x: Column, scale: Column, lo: float = LOW, hi: float = HIGH, n_tokens: int = N_TOKENS,
          n_special: int = N_SPECIAL) -> Column:
    """Uniform-bin token of x / scale; values beyond the bins take the outermost ones."""
    bins = n_tokens - n_special - 1
    at = F.floor((x / scale - lo) / _step(lo, hi, n_tokens, n_special) + 0.5) + 1
    return (F.least(F.greatest(at, F.lit(1)), F.lit(bins)) + n_special).cast("int")


def detoken(tok: Column, scale: Column, lo: float = LOW, hi: float = HIGH,
            n_tokens: int = N_TOKENS, n_special: int = N_SPECIAL) -> Column:
    """Bin centre times scale."""
    bins = n_tokens - n_special - 1
    at = F.least(F.greatest(tok - n_special - 1, F.lit(0)), F.lit(bins - 1))
    return (at * _step(lo, hi, n_tokens, n_special) + lo) * scale


def tokenize_windows(windows: DataFrame, scale: Column | None = None, **bins) -> DataFrame:
    """Tokens of context and future under one scale: the given one, or each window's own."""
    out = windows.withColumn("scale", scale) if scale is not None else windows
    return out.withColumns({f"{a}_tok": F.transform(a, lambda v: token(v, F.col("scale"), **bins))
                            for a in ("x", "y")})


def window_report(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Size and range of a set of windows: count, token range, scale range, first and last start."""
    low = {a: F.array_min(f"{a}_tok") for a in ("x", "y")}
    high = {a: F.array_max(f"{a}_tok") for a in ("x", "y")}
    aggs = [F.count(F.lit(1)).alias("n_windows")]
    for a in ("x", "y"):
        aggs += [F.min(low[a]).alias(f"{a}_tok_min"), F.max(high[a]).alias(f"{a}_tok_max"),
                 F.avg(array_mean(f"{a}_tok", lambda v: v.cast("double"))).alias(f"{a}_tok_mean")]
    aggs += [F.min("scale").alias("scale_min"), F.avg("scale").alias("scale_mean"),
             F.max("scale").alias("scale_max"), F.min("start_t").alias("first_start"),
             F.max("start_t").alias("last_start")]
    return tokens.groupBy(*by).agg(*aggs)


def naive_forecast(windows: DataFrame, keys: list[str], pred: int = PRED_LEN) -> DataFrame:
    """The last context value repeated over the horizon, one row per step."""
    return windows.select(*keys, "window", F.explode(F.sequence(F.lit(1), F.lit(pred))).alias("horizon"),
                          F.element_at("x", -1).alias("naive"))
