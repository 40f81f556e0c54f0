"""Recursive indicators kept per series while bars arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelspark.operators.indicators import add_emas, add_rsi
from panelspark.schema import Series
from panelspark.session import stage

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VALUES = ["ema_fast", "ema_slow", "rsi"]
STATE = "last_t double, last_close double, fast double, slow double, deltas array<double>"


def indicator_stream(bars: DataFrame, key: str = "id", t: str = "t", close: str = "close",
                     fast: int = 12, slow: int = 26, n: int = 14) -> DataFrame:
    """EMA pair, MACD and RSI per bar, equal to the batch forms.

    State per series: the last bar, both means and the last n differences. Bars of one trigger are
    put in time order; a bar not newer than the state comes out with `late` set and no values;
    `repaired` gives the series that had one anew. Cap a trigger with the source's maxFilesPerTrigger.
    """
    types = dict(bars.dtypes)
    out = (f"`{key}` {types[key]}, `{t}` {types[t]}, `{close}` double, ema_fast double, "
           "ema_slow double, macd double, rsi double, late boolean")
    a_fast, a_slow = 2 / (fast + 1), 2 / (slow + 1)

    def update(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_t, last, ef, es, deltas = state.get if state.exists else (None, None, None, None, [])
        deltas = list(deltas)
        rows = pd.concat(list(frames)).sort_values(t, kind="stable")
        result = []
        for when, x in zip(rows[t], rows[close]):
            at = pd.Timestamp(when).value / 1e3
            if last_t is not None and at <= last_t:
                result.append((k[0], when, x, None, None, None, None, True))
                continue
            if last is None:
                ef = es = float(x)
            else:
                ef, es = ef + a_fast * (x - ef), es + a_slow * (x - es)
                deltas = (deltas + [float(x - last)])[-n:]
            rsi = None
            if len(deltas) == n:
                up, down = sum(max(d, 0.0) for d in deltas), sum(max(-d, 0.0) for d in deltas)
                rsi = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
            last_t, last = at, float(x)
            result.append((k[0], when, x, ef, es, ef - es, rsi, False))
        state.update((last_t, last, ef, es, deltas))
        yield pd.DataFrame(result, columns=[key, t, close, "ema_fast", "ema_slow", "macd", "rsi", "late"])

    return bars.select(key, t, close).groupBy(key).applyInPandasWithState(
        update, out, STATE, "append", GroupStateTimeout.NoTimeout)


def repaired(emitted: DataFrame, s: Series, close: str = "close", fast: int = 12, slow: int = 26,
             n: int = 14) -> DataFrame:
    """What the stream has put out, with series that had a late bar computed anew in batch.

    Late bars come out of the stream with their price, so the emitted rows hold every bar. Only the
    affected series are read again; their rows keep `late`.
    """
    hit = emitted.filter("late").select(*s.keys).distinct()
    bars = stage(emitted.join(hit, s.keys, "left_semi").select(*s.keys, s.t, close, "late"), "late-series")
    again = stage(add_emas(bars, s, close, {"ema_fast": fast, "ema_slow": slow}), "late-means")
    again = add_rsi(again, s, close, n).withColumnRenamed("RSI", "rsi").withColumn("macd", F.col("ema_fast") - F.col("ema_slow"))
    return emitted.join(hit, s.keys, "left_anti").unionByName(again.select(emitted.columns))


# ── bars that may come out of order, sorted by event-time timers ────────────
@contextmanager
def timers(spark: SparkSession):
    """State with timers needs the RocksDB provider; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Recurrence:
    """The means and the last n differences of one series, moved on bar by bar.

    `state` is (last time, last close, fast mean, slow mean, differences), or None before the first bar.
    """

    def __init__(self, fast: int, slow: int, n: int, state: tuple | None = None):
        self.a_fast, self.a_slow, self.n = 2 / (fast + 1), 2 / (slow + 1), n
        self.last_t, self.last, self.ema_fast, self.ema_slow, deltas = state or (None, None, None, None, [])
        self.deltas = list(deltas)

    @property
    def state(self) -> tuple:
        return self.last_t, self.last, self.ema_fast, self.ema_slow, self.deltas

    def values(self, when: int, x: float) -> tuple:
        """Both means and the RSI after a bar; nothing for a bar that is not newer than the last one."""
        if self.last_t is not None and when <= self.last_t:
            return None, None, None, True
        if self.last is None:
            self.ema_fast = self.ema_slow = x
        else:
            self.ema_fast += self.a_fast * (x - self.ema_fast)
            self.ema_slow += self.a_slow * (x - self.ema_slow)
            self.deltas = (self.deltas + [x - self.last])[-self.n:]
        self.last_t, self.last, rsi = when, x, None
        if len(self.deltas) == self.n:
            up, down = sum(max(d, 0.0) for d in self.deltas), sum(max(-d, 0.0) for d in self.deltas)
            rsi = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
        return self.ema_fast, self.ema_slow, rsi, False


class OrderedBars(StatefulProcessor):
    """Keeps a series' bars until the watermark has passed them, then moves its recurrences on in time order.

    State is the bars that are still open, as many as the delay holds, and one small row. A series
    has one timer at a time, set to its earliest open bar.
    """

    def __init__(self, fast: int, slow: int, n: int):
        self.set_up = (fast, slow, n)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "micros long, x double")
        self.past = handle.getValueState("past", "last_t long, last double, fast double, slow double, deltas array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            at = pdf["micros"]
            self.open.appendList([(int(t), float(x)) for t, x in zip(at, pdf["x"])])
            first = int(at.min()) if first is None else min(first, int(at.min()))
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        bars = sorted((r[0], r[1]) for r in self.open.get())
        due = [b for b in bars if b[0] <= until]
        left = bars[len(due):]
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if not due:
            if left:
                self._wake(left[0][0], fired)
            return
        made = Recurrence(*self.set_up, self.past.get() if self.past.exists() else None)
        rows = [(key[0], t, x, *made.values(t, x)) for t, x in due]
        self.past.update(made.state)
        if left:
            self.open.put(left)
            self._wake(left[0][0], fired)
        else:
            self.open.clear()
        yield pd.DataFrame(rows, columns=["series", "micros", "x", *VALUES, "late"])

    def _wake(self, micros: int, fired: int | None = None) -> None:
        """One timer at the earliest open bar, rounded up to the millisecond; one that is firing no longer counts."""
        when = -(-micros // 1000)
        waiting = [t for t in self.handle.listTimers() if t != fired]
        if waiting and min(waiting) <= when:
            return
        for t in waiting:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(when)

    def close(self) -> None:
        pass


def ordered_indicator_stream(bars: DataFrame, key: str = "id", t: str = "t", close: str = "close", delay: str = "1 day",
                             fast: int = 12, slow: int = 26, n: int = 14) -> DataFrame:
    """EMA pair, MACD and RSI per bar, whatever order bars come in within `delay`.

    A bar comes out once the watermark has passed it, so a bar up to `delay` late takes its place and
    nothing needs repair. Later ones are dropped by the watermark; `open_bars` gives the bars that are
    open when the input ends, and `late` marks a second bar of one time. Start the query inside `timers`.
    Times without a zone are read in the session's.
    """
    # the processor sees names of its own: those with a leading underscore do not reach it
    rows = bars.select(F.col(key).alias("series"), F.col(t).cast("timestamp").alias("t"), F.col(close).cast("double").alias("x"))
    rows = rows.withWatermark("t", delay).withColumn("micros", F.unix_micros("t"))
    out = rows.groupBy("series").transformWithStateInPandas(
        OrderedBars(fast, slow, n),
        f"series {dict(rows.dtypes)['series']}, micros long, x double, ema_fast double, ema_slow double, rsi double, late boolean",
        "append", "eventTime")
    return _with_macd(out, key, t, close, dict(bars.dtypes)[t])


def _with_macd(out: DataFrame, key: str, t: str, close: str, kind: str) -> DataFrame:
    return out.select(F.col("series").alias(key), F.timestamp_micros("micros").cast(kind).alias(t), F.col("x").alias(close),
                      "ema_fast", "ema_slow", (F.col("ema_fast") - F.col("ema_slow")).alias("macd"), "rsi", "late")


def open_bars(bars: DataFrame, emitted: DataFrame, key: str = "id", t: str = "t", close: str = "close",
              fast: int = 12, slow: int = 26, n: int = 14) -> DataFrame:
    """The same for the bars the stream still holds: the flush at the end of the input.

    A series goes on from what it has put out last: its newest row has the means, its newest n + 1
    closes the differences. So a task gets a series' open bars and n + 1 rows, never the series.
    Bars that the watermark dropped are older than what was put out and are left out.
    """
    done = emitted.filter(~F.col("late")).select(
        F.col(key).alias("series"), F.unix_micros(F.col(t).cast("timestamp")).alias("micros"), F.col(close).alias("x"), "ema_fast", "ema_slow")
    newest = Window.partitionBy("series").orderBy(F.desc("micros"))
    tail = done.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n + 1).drop("place")
    ends = done.groupBy("series").agg(F.max("micros").alias("until"))
    still = bars.select(F.col(key).alias("series"), F.unix_micros(F.col(t).cast("timestamp")).alias("micros"), F.col(close).cast("double").alias("x"))
    still = still.join(ends, "series", "left").filter(F.col("until").isNull() | (F.col("micros") > F.col("until"))).drop("until")
    nothing = F.lit(None).cast("double")
    both = tail.withColumn("open", F.lit(False)).unionByName(
        still.withColumns({"ema_fast": nothing, "ema_slow": nothing, "open": F.lit(True)}))

    def go_on(k, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("micros", kind="stable")
        old, new = pdf[~pdf["open"]], pdf[pdf["open"]]
        state = None
        if len(old):
            end = old.iloc[-1]
            state = (int(end["micros"]), float(end["x"]), float(end["ema_fast"]), float(end["ema_slow"]),
                     old["x"].diff().dropna().tolist())
        made = Recurrence(fast, slow, n, state)
        rows = [(k[0], int(t), float(x), *made.values(int(t), float(x))) for t, x in zip(new["micros"], new["x"])]
        return pd.DataFrame(rows, columns=["series", "micros", "x", *VALUES, "late"])

    out = both.groupBy("series").applyInPandas(
        go_on, f"series {dict(both.dtypes)['series']}, micros long, x double, ema_fast double, ema_slow double, rsi double, late boolean")
    return _with_macd(out, key, t, close, dict(bars.dtypes)[t])
