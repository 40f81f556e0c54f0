"""Streaming forms: late bars, held-back months, resumption."""

from __future__ import annotations

import datetime as dt
import json

from panelspark.streaming.indicators import PROVIDER, indicator_stream, open_bars, ordered_indicator_stream, timers
from panelspark.streaming.ingest import closed_months_glob, drain, ingest_stream


def bars(spark, rows):
    return spark.createDataFrame([("a", dt.datetime(2024, 1, d), x) for d, x in rows], "id string, t timestamp, close double")


def test_state_continues_and_late_bars_are_set_aside(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    first, second = [(i, float(i % 5 + 1)) for i in range(1, 11)], [(i, float(i % 7 + 1)) for i in range(11, 21)]
    for part in (first, [*second, (3, 99.0)]):
        bars(spark, part).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id string, t timestamp, close double").parquet(src)
        drain(indicator_stream(stream, n=3), out, ck)
    got = spark.read.parquet(out).orderBy("t", "late").toPandas()
    assert got["late"].sum() == 1 and len(got) == 21
    ok = got[~got["late"]]
    assert abs(ok["close"].ewm(span=12, adjust=False).mean() - ok["ema_fast"]).max() < 1e-12


def test_timers_order_bars_inside_the_delay(spark, tmp_path):
    """Late bars take their place, too late ones are dropped, the flush goes on from what came out."""
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    price = {d: float(d * d % 7 + 1) for d in range(1, 31)}
    parts = [[2, 1, 5, 6], [4, 3, 9, 7, 12], [8, 10, 11, 20, 30], [13, 29]]
    quiet = spark.createDataFrame([("b", dt.datetime(2024, 1, d), 1.0) for d in (6, 1, 5)], "id string, t timestamp, close double")
    quiet.write.parquet(src)
    before = spark.conf.get(PROVIDER, None)
    for part in parts:
        bars(spark, [(d, price[d]) for d in part]).write.mode("append").parquet(src)
        with timers(spark):
            rows = spark.readStream.schema("id string, t timestamp, close double").parquet(src)
            drain(ordered_indicator_stream(rows, delay="5 days", n=3), out, ck)
    assert spark.conf.get(PROVIDER, None) == before
    emitted = spark.read.parquet(out)
    # a series without new bars goes on by its own timers
    assert sorted(r["t"].day for r in emitted.filter("id = 'b'").collect()) == [1, 5, 6]
    every = open_bars(spark.read.parquet(src), emitted, n=3)
    assert every.filter("id = 'b'").count() == 0
    emitted, rest = emitted.filter("id = 'a'"), every.filter("id = 'a'")
    assert {r["t"].day for r in emitted.collect()} == {*range(1, 13), 20}
    assert {r["t"].day for r in rest.collect()} == {29, 30}
    got = emitted.unionByName(rest).orderBy("t").toPandas()
    assert not got["late"].any()
    assert abs(got["close"].ewm(span=12, adjust=False).mean() - got["ema_fast"]).max() < 1e-12
    assert abs(got["close"].ewm(span=26, adjust=False).mean() - got["ema_slow"]).max() < 1e-12
    step = got["close"].diff()
    up, down = step.clip(lower=0).rolling(3).sum(), (-step.clip(upper=0)).rolling(3).sum()
    want = (100 - 100 / (1 + up / down)).where(down > 0, 100.0).where(up.notna())
    assert got["rsi"].isna().equals(want.isna()) and abs(got["rsi"] - want).max() < 1e-9


def test_flush_of_a_stream_that_put_nothing_out(spark):
    all_bars = bars(spark, [(d, float(d)) for d in (3, 1, 2)])
    none = open_bars(all_bars, open_bars(all_bars, spark.createDataFrame(
        [], "id string, t timestamp, close double, ema_fast double, ema_slow double, macd double, rsi double, late boolean")))
    assert none.count() == 0


def test_running_month_waits(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    for m in ("2024-01", "2024-02"):
        (src / f"arts-{m}.json").write_text(json.dumps({"_id": m}) + "\n")
    seen = []
    for today in (dt.date(2024, 2, 20), dt.date(2024, 2, 25), dt.date(2024, 3, 1)):
        drain(ingest_stream(spark, str(src), today, 2024), out, ck)
        seen.append(sorted(r["_id"] for r in spark.read.parquet(out).collect()))
    assert seen == [["2024-01"], ["2024-01"], ["2024-01", "2024-02"]]
    assert closed_months_glob(dt.date(2024, 3, 1), 2024) == "*{2024-01,2024-02}*"
