"""Streaming forms, drained over the given tables and compared with the batch result."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from panelspark.catalog import query
from panelspark.catalog.indicators import W, ema_sql, rsi_sql
from panelspark.catalog.inputs import HOUR, SQL_HOUR, SQL_SCORED, bars_hour, rnd, scored
from panelspark.catalog.news import articles
from panelspark.operators.calendar import PROB_COLS
from panelspark.session import shared_dir
from panelspark.streaming.indicators import (
    indicator_stream, open_bars, ordered_indicator_stream, repaired, timers)
from panelspark.streaming.ingest import daily_news_stream, drain, ingest_stream, open_days


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream_of(df, name):
    """The rows of a table as a file stream."""
    spark = df.sparkSession
    path = _folder(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("stream_daily_news", time="date", sql=f"""with {SQL_SCORED}
select date, round(avg(prob_positive), 6) prob_positive, round(avg(prob_negative), 6) prob_negative,
  round(avg(prob_neutral), 6) prob_neutral, round(avg(cast(embedding[1] as double)), 6) + 0.0 e1, count(*) n_articles,
  case when avg(prob_positive) >= avg(prob_negative) and avg(prob_positive) >= avg(prob_neutral) then 'positive'
       when avg(prob_negative) >= avg(prob_neutral) then 'negative' else 'neutral' end as label
from scored group by 1""")
def stream_daily_news(spark, sf):
    """Days the watermark has closed, and the flush of those still open at the end of the input."""
    rows = scored(spark, sf).withColumn("ts", F.col("date").cast("timestamp")).drop("date")
    src = _stream_of(rows, "scored")
    out = _folder(spark, "daily")
    drain(daily_news_stream(src, "ts"), out, _folder(spark, "daily-checkpoint"))
    closed = spark.read.parquet(out)
    d = closed.unionByName(open_days(rows, closed, "ts"))
    return d.select("date", *[rnd(c).alias(c) for c in PROB_COLS],
                    rnd(F.get("embedding", F.lit(0))).alias("e1"), "n_articles", "label")


@query("stream_indicators", time="t", sql=f"""with {SQL_HOUR}, d as (select *, close - lag(close) {W} delta from bars_hour)
select id, t, round({ema_sql("close", 12)}, 6) ema_fast, round({ema_sql("close", 26)}, 6) ema_slow, round({rsi_sql("delta", 14)}, 6) rsi, false late from d""")
def stream_indicators(spark, sf):
    src = _stream_of(bars_hour(spark, sf).select("id", "t", "close"), "bars")
    out = _folder(spark, "indicators")
    drain(indicator_stream(src), out, _folder(spark, "indicators-checkpoint"))
    return spark.read.parquet(out).select("id", "t", rnd("ema_fast").alias("ema_fast"),
                                          rnd("ema_slow").alias("ema_slow"), rnd("rsi").alias("rsi"), "late")


@query("stream_indicators_late", time="t", sql=f"""with {SQL_HOUR}, d as (select *, close - lag(close) {W} delta from bars_hour)
select id, t, round({ema_sql("close", 12)}, 6) ema_fast, round({ema_sql("close", 26)}, 6) ema_slow, round({rsi_sql("delta", 14)}, 6) rsi from d""")
def stream_indicators_late(spark, sf):
    """Some bars of some series come a trigger too late; after the repair all is as in batch."""
    bars = bars_hour(spark, sf).select("id", "t", "close")
    late = "length(id) % 2 = 0 and hour(t) % 6 = 1"
    src, out, checkpoint = (_folder(spark, f"late-{n}") for n in ("bars", "indicators", "checkpoint"))
    for part in (f"not ({late})", late):
        bars.filter(part).write.mode("append").parquet(src)
        drain(indicator_stream(spark.readStream.schema(bars.schema).parquet(src)), out, checkpoint)
    found = repaired(spark.read.parquet(out), HOUR)
    return found.select("id", "t", *[rnd(c).alias(c) for c in ("ema_fast", "ema_slow", "rsi")])


@query("stream_indicators_ordered", time="t", sql=f"""with {SQL_HOUR}, d as (select *, close - lag(close) {W} delta from bars_hour)
select id, t, round({ema_sql("close", 12)}, 6) ema_fast, round({ema_sql("close", 26)}, 6) ema_slow, round({rsi_sql("delta", 14)}, 6) rsi, false late from d""")
def stream_indicators_ordered(spark, sf):
    """Bars come in three parts, some bars of a part's last month one part later; timers put them in order."""
    bars = bars_hour(spark, sf).select("id", "t", "close")
    src, out, checkpoint = (_folder(spark, f"ordered-{n}") for n in ("bars", "indicators", "checkpoint"))
    cuts = [F.lit(c).cast("timestamp") for c in ("1994-06-01", "1996-06-01")]
    part = sum(((F.col("t") >= c).cast("int") for c in cuts), F.lit(0))
    slow = (F.length("id") % 2 == 0) & (F.hour("t") % 6 == 1)
    month_before = [(F.col("t") >= c - F.expr("interval 30 days")) & (F.col("t") < c) for c in cuts]
    arrives = part + (slow & (month_before[0] | month_before[1])).cast("int")
    with timers(spark):
        for i in range(3):
            bars.filter(arrives == i).write.mode("append").parquet(src)
            rows = spark.readStream.schema(bars.schema).parquet(src)
            drain(ordered_indicator_stream(rows, delay="60 days"), out, checkpoint)
    emitted = spark.read.parquet(out)
    found = emitted.unionByName(open_bars(bars, emitted))
    return found.select("id", "t", *[rnd(c).alias(c) for c in ("ema_fast", "ema_slow", "rsi")], "late")


@query("stream_article_ingest", """select '2024-01' batch_month, count(*) n, count(distinct doc_id) n_articles from documents
where doc_id * doc_id % 61 < 31 union all
select '2024-02', count(*), count(distinct doc_id) from documents where doc_id * doc_id % 61 between 31 and 59""")
def stream_article_ingest(spark, sf):
    """Monthly files, the running month held back, drained twice: nothing is read again."""
    a = articles(spark, sf).select(
        F.col("doc_id").cast("string").alias("_id"), "abstract", F.struct(F.col("headline").alias("main")).alias("headline"),
        "pub_date", "news_desk", "section_name", "keywords")
    landing = _folder(spark, "landing")
    a.withColumn("m", F.substring("pub_date", 1, 7)).write.partitionBy("m").json(landing)
    src = _named_by_month(spark, landing)
    out, ckpt = _folder(spark, "ingested"), _folder(spark, "ingest-checkpoint")
    for _ in range(2):
        drain(ingest_stream(spark, src, dt.date(2024, 3, 1), 2024), out, ckpt)
    return spark.read.parquet(out).groupBy("batch_month").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("_id").alias("n_articles"))


def _named_by_month(spark, landing):
    """Give each part file the month in its name, as the landing zone has it."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(landing)
    fs = root.getFileSystem(conf)
    flat = landing + "-flat"
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(flat))
    for month in fs.listStatus(root):
        name = month.getPath().getName()
        if not name.startswith("m="):
            continue
        for i, part in enumerate(fs.listStatus(month.getPath())):
            if part.getPath().getName().endswith(".json"):
                target = jvm.org.apache.hadoop.fs.Path(f"{flat}/articles-{name[2:]}-{i}.json")
                if not fs.rename(part.getPath(), target):
                    raise OSError(f"cannot name {part.getPath()}")
    return flat
