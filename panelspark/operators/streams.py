"""Forecast windows over several aligned streams: target, covariates, known-ahead columns and news vectors.

A stored window row would repeat every covariate and vector `ctx` times. Here a segment of a series
goes to a task once, with the `ctx` rows before it and the `pred` rows after it, and each window is
a view of its arrays. The task tokenises the context under the window's scale, asks the forecaster,
decodes the drawn tokens with the same scale and rebuilds levels, so that one row per step leaves it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import windows as X
from panelspark.operators.segments import OWN, ROW, SEG, segmented
from panelspark.schema import Series

COV, KNOWN, NEWS = "_covariates", "_known", "_news"


@dataclass(frozen=True)
class StreamWindow:
    """What a forecaster sees of one window. Rows are time steps; a stream that is absent has no columns."""

    x: np.ndarray           # ctx: the target
    tokens: np.ndarray      # ctx: its tokens under `scale`
    scale: float
    covariates: np.ndarray  # ctx x covariates
    news: np.ndarray        # ctx x vector
    known: np.ndarray       # pred x known-ahead columns, of the steps to forecast


def join_streams(target: DataFrame, s: Series, covariates: DataFrame | None = None, shared: DataFrame | None = None,
                 known: DataFrame | None = None, news: DataFrame | None = None, vector: str = "embedding",
                 dim: int = 0) -> DataFrame:
    """The target's rows with the other streams beside them, as arrays in the order of their columns.

    `covariates` has the series' keys and time; `shared`, `known` and `news` have the time alone and serve
    every series. Streams are aligned by position later, so a target row without a covariate or a known-ahead
    row is an error; a day without news gets a zero vector of `dim` components.
    """
    out, streams = target, []
    for rows, on, name in ((covariates, [*s.keys, s.t], "_cov_own"), (shared, [s.t], "_cov_shared"), (known, [s.t], KNOWN)):
        if rows is None:
            continue
        cols = [c for c in rows.columns if c not in on]
        packed = rows.select(*on, F.array(*[F.col(c).cast("double") for c in cols]).alias(name))
        out = out.join(packed, on, "left")
        streams.append(name)
    if streams:
        lost = out.filter(F.greatest(*[F.col(c).isNull() for c in streams], F.lit(False))).limit(1).count()
        if lost:
            raise ValueError(f"streams are not aligned on {s.t}: a row of the target has no row of {streams}")
    own = [c for c in ("_cov_own", "_cov_shared") if c in streams]
    empty = F.array().cast("array<double>")
    out = out.withColumn(COV, F.concat(*own) if own else empty).drop(*own)
    if KNOWN not in streams:
        out = out.withColumn(KNOWN, empty)
    if news is None:
        return out.withColumn(NEWS, F.array().cast("array<float>"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    days = news.select(s.t, F.col(vector).cast("array<float>").alias(NEWS))
    return out.join(days, s.t, "left").withColumn(NEWS, F.coalesce(NEWS, zero))


def token_array(x: np.ndarray, scale: float, lo: float = X.LOW, hi: float = X.HIGH, n_tokens: int = X.N_TOKENS,
                n_special: int = X.N_SPECIAL) -> np.ndarray:
    """`windows.token` over an array."""
    at = np.floor((x / scale - lo) / X._step(lo, hi, n_tokens, n_special) + 0.5) + 1
    return (np.clip(at, 1, n_tokens - n_special - 1) + n_special).astype(np.int64)


def detoken_array(tokens: np.ndarray, scale: float, lo: float = X.LOW, hi: float = X.HIGH, n_tokens: int = X.N_TOKENS,
                  n_special: int = X.N_SPECIAL) -> np.ndarray:
    """`windows.detoken` over an array."""
    at = np.clip(tokens - n_special - 1, 0, n_tokens - n_special - 2)
    return (at * X._step(lo, hi, n_tokens, n_special) + lo) * scale


def _rows(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """An array column as a matrix; all rows are equally long."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), dtype)


def forecast_streams(panel: DataFrame, s: Series, fn: Callable[[StreamWindow, int, int, int], np.ndarray],
                     ctx: int = X.CTX_LEN, pred: int = X.PRED_LEN, mc: int = 100, seed: int = 0, mode: str = "no_diff",
                     target: str = "x", raw: str = "raw", scale: str | None = None, keep_tokens: bool = False,
                     size: int = 512, **bins) -> DataFrame:
    """Steps ready for `score_ensembles`: (keys, window, horizon, t, scale, ens, truth, naive[, tokens]).

    `fn(window, pred, mc, seed)` gives mc x pred token ids. They are decoded with the window's scale: that of the
    column `scale` (one for all windows of a series, say of its training rows), else the context's mean
    absolute value. Then differences are summed onto the last raw value of the context. `panel` comes
    from `join_streams`, differenced and split, with the row's position if it has been numbered. The seed of a
    window mixes the series, the window and the given one, so a retried task draws the same.
    """
    cols = [s.t, target, raw, COV, KNOWN, NEWS, *([scale] if scale else [])]
    keep = panel.select(*s.keys, *dict.fromkeys(cols), *([ROW] if ROW in panel.columns else []))
    seg = segmented(keep, s, back=ctx, ahead=pred - 1, size=size)
    types = dict(seg.dtypes)
    schema = (", ".join(f"`{k}` {types[k]}" for k in s.keys) + f", window bigint, horizon int, t {types[s.t]}, scale double, "
              "ens array<double>, truth double, naive double" + ", tokens array<long>" * keep_tokens)

    def levels(d: np.ndarray, anchor: float) -> np.ndarray:
        if mode == "log_diff":
            return anchor * np.exp(d.cumsum(axis=1))
        return d if mode == "no_diff" else anchor + d.cumsum(axis=1)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows, series = rows.sort_by(ROW), [k.as_py() for k in key[:-1]]
        place, mine = rows.column(ROW).to_numpy(), rows.column(OWN).to_numpy(zero_copy_only=False)
        x, level = (rows.column(c).to_numpy().astype(float) for c in (target, raw))
        cov, known, news = _rows(rows.column(COV), float), _rows(rows.column(KNOWN), float), _rows(rows.column(NEWS), np.float32)
        fixed = rows.column(scale).to_numpy().astype(float) if scale else None
        times = rows.column(s.t)
        number, when, steps, scales, ens, drawn = [], [], [], [], [], []
        for i in np.flatnonzero(mine):
            if i < ctx or i + pred > len(x):
                continue
            past = x[i - ctx:i]
            # the same mean of known values as in `sliding_windows`; 1 where there is none
            size_of = fixed[i] if scale else np.nanmean(np.abs(past)) if not np.isnan(past).all() else 0.0
            size_of = float(size_of) if size_of > 0 else 1.0
            w = StreamWindow(past, token_array(np.nan_to_num(past), size_of, **bins), size_of, cov[i - ctx:i], news[i - ctx:i],
                             known[i:i + pred])
            tokens = np.asarray(fn(w, pred, mc, zlib.crc32(f"{series} {place[i]} {seed}".encode())))
            if tokens.shape != (mc, pred):
                raise ValueError(f"forecaster returned {tokens.shape}, wanted {(mc, pred)}")
            ens += list(np.sort(levels(detoken_array(tokens, size_of, **bins), level[i - 1]), axis=0).T)
            drawn += list(tokens.T)
            number.append(int(place[i]) - ctx)
            when.append(i)
            steps.append(level[i:i + pred])
            scales.append(size_of)
        n = len(number)
        at = np.array([i + k for i in when for k in range(pred)], dtype=np.int64)
        data = {**{k: pa.array([key[j].as_py()] * (n * pred), rows.schema.field(k).type) for j, k in enumerate(s.keys)},
                "window": pa.array(np.repeat(np.array(number, dtype=np.int64), pred)),
                "horizon": pa.array(np.tile(np.arange(1, pred + 1, dtype=np.int32), n)), "t": times.take(pa.array(at)),
                "scale": pa.array(np.repeat(np.array(scales, dtype=float), pred)), "ens": pa.array(ens, pa.list_(pa.float64())),
                "truth": pa.array(np.concatenate(steps) if n else np.zeros(0)),
                "naive": pa.array(np.repeat(level[np.array(when, dtype=np.int64) - 1], pred) if n else np.zeros(0))}
        if keep_tokens:
            data["tokens"] = pa.array(drawn, pa.list_(pa.int64()))
        return pa.table(data)

    return seg.groupBy(*s.keys, SEG).applyInArrow(run, schema)
