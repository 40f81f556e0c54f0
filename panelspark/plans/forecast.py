"""From a price panel to a scored forecast run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import evaluate as E
from panelspark.operators import windows as X
from panelspark.operators.streams import forecast_streams, join_streams
from panelspark.operators.indicators import difference
from panelspark.schema import Series
from panelspark.session import stage


def run_forecast(prices: DataFrame, s: Series, forecaster, price: str = "close",
                 mode: str = "log_diff", ctx: int = X.CTX_LEN, pred: int = X.PRED_LEN,
                 test: int = X.TEST_ROWS, val: int = X.VAL_ROWS, splits: tuple = ("test",),
                 mc: int = 100, seed: int = 0, max_windows: int | None = None) -> dict[str, DataFrame]:
    """Difference, split, window, forecast, return to prices, score.

    Scores are in price space: samples are rebuilt from the last raw context price, which is also
    the persistence forecast. Returns `windows`, `steps`, `forecasts`, `per_window`, `summary`;
    keys are the series and the split.
    """
    keys = [*s.keys, "split"]
    both = difference(prices.select(*s.keys, s.t, F.col(price).alias("x"), F.col(price).alias("raw")), s, ["x"], mode)
    parts = X.temporal_split(stage(both, "differences"), s, test, val, ctx).filter(F.col("split").isin(*splits))
    win = X.sliding_windows(parts, Series(tuple(keys), s.t), ctx, pred, "x", ["raw"], ["raw"])
    if max_windows:
        win = E.limit_windows(win, max_windows)
    win = stage(win.withColumn("anchor", F.element_at("x_raw", -1)), "windows")
    drawn = E.forecast_ensembles(win, keys, forecaster, pred, mc, seed, mode, "anchor", "y_raw")
    steps = stage(E.score_ensembles(drawn), "steps")
    per_window = stage(E.per_window_metrics(steps, keys), "window-metrics")
    return {"windows": win, "steps": steps, "forecasts": E.forecast_table(steps, keys),
            "per_window": per_window, "summary": E.summarise(per_window, keys, pred)}


def run_stream_forecast(prices: DataFrame, s: Series, forecaster, price: str = "close", covariates: DataFrame | None = None,
                        shared: DataFrame | None = None, known: DataFrame | None = None, news: DataFrame | None = None,
                        vector: str = "embedding", dim: int = 0, mode: str = "log_diff", global_scale: bool = False,
                        ctx: int = X.CTX_LEN, pred: int = X.PRED_LEN, test: int = X.TEST_ROWS, val: int = X.VAL_ROWS,
                        splits: tuple = ("test",), mc: int = 100, seed: int = 0) -> dict[str, DataFrame]:
    """The forecast run over all streams: difference the target, put the streams beside it, split, forecast, score.

    Only the target is differenced; covariates keep their level. With `global_scale` windows of every split are
    tokenised under the scale of the series' training rows, else each under its own. Returns `steps` (with the
    drawn tokens), `per_window` and `summary`; keys are the series and the split.
    """
    keys = [*s.keys, "split"]
    both = difference(prices.select(*s.keys, s.t, F.col(price).alias("x"), F.col(price).alias("raw")), s, ["x"], mode)
    panel = stage(join_streams(stage(both, "differences"), s, covariates, shared, known, news, vector, dim), "streams")
    parts, scale = X.temporal_split(panel, s, test, val, ctx), None
    if global_scale:
        train = X.global_scale(parts.filter(F.col("split") == "train"), s, "x").withColumnRenamed("scale", "_scale")
        parts, scale = parts.join(train, s.keys, "left").fillna(1.0, ["_scale"]), "_scale"
    parts = parts.filter(F.col("split").isin(*splits))
    drawn = stage(forecast_streams(parts, Series(tuple(keys), s.t), forecaster, ctx, pred, mc, seed, mode, scale=scale,
                                   keep_tokens=True), "drawn")
    steps = stage(E.score_ensembles(drawn), "steps")
    per_window = stage(E.per_window_metrics(steps, keys), "window-metrics")
    return {"steps": steps, "per_window": per_window, "summary": E.summarise(per_window, keys, pred)}
