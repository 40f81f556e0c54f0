"""Incremental ingest of monthly article files and daily aggregation as articles arrive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelspark.functions.calendar import last_complete_month, months
from panelspark.operators.calendar import first_max_label
from panelspark.operators.news import mean_embedding
from panelspark.schema import ARTICLE, PROB_COLS, PROB_LABELS


def closed_months_glob(today: dt.date, start_year: int) -> str:
    """File-name filter that admits the months that have fully passed.

    The filter grows from run to run; a file of the running month is not listed at all, so it is
    picked up, once, when its month has closed.
    """
    closed = months(start_year, last_complete_month(today))
    return "*{" + ",".join(f"{y}-{m:02d}" for y, m in closed) + "}*"


def ingest_stream(spark: SparkSession, landing: str, today: dt.date, start_year: int = 2007,
                  max_files: int = 200) -> DataFrame:
    """Articles of closed months from a landing folder of `..YYYY-MM..json` files."""
    df = (spark.readStream.schema(ARTICLE)
          .option("pathGlobFilter", closed_months_glob(today, start_year))
          .option("maxFilesPerTrigger", max_files).json(landing))
    return df.withColumn("batch_month", F.regexp_extract(F.col("_metadata.file_path"),
                                                         r"(\d{4}-\d{2})[^/]*$", 1))


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available into parquet, then stop; a rerun continues from the checkpoint."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def daily_news_stream(df: DataFrame, ts: str, delay: str = "2 days", vector: str | None = "embedding",
                      probs=PROB_COLS, labels=PROB_LABELS) -> DataFrame:
    """Daily mean embedding, mean probabilities and label; a day is final once the watermark passed it.

    State is one running aggregate per open day, combined map-side like the batch form. `open_days`
    gives the days that are still open when the input ends.
    """
    out = df.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("_w")).agg(*_daily(vector, probs))
    return _labelled(out.withColumn("date", F.to_date(F.col("_w.start"))).drop("_w"), probs, labels)


def open_days(rows: DataFrame, closed: DataFrame, ts: str, vector: str | None = "embedding",
              probs=PROB_COLS, labels=PROB_LABELS) -> DataFrame:
    """The same for the days that the stream has not closed: the flush at the end of the input.

    `rows` are all rows of the source, `closed` what the stream has put out. Only days that miss there
    are aggregated, so a flush costs the last days alone when rows are laid out by time.
    """
    left = rows.withColumn("date", F.to_date(ts)).join(closed.select("date").distinct(), "date", "left_anti")
    return _labelled(left.groupBy("date").agg(*_daily(vector, probs)), probs, labels)


def _daily(vector: str | None, probs) -> list:
    aggs = [F.avg(p).alias(p) for p in probs]
    if vector:
        aggs.append(mean_embedding(vector).alias(vector))
    return [*aggs, F.count(F.lit(1)).alias("n_articles")]


def _labelled(days: DataFrame, probs, labels) -> DataFrame:
    return days.withColumn("label", first_max_label([F.col(p) for p in probs], labels))
