"""The fixture shapes derived from the driver tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.schema import Series
from panelspark.sources.bars import bars

DAY = HOUR = Series(("id",), "t")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rnd(c, n: int = 6) -> Column:
    """Rounded to n places, negative zero removed."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def bars_hour(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return bars(e, F.col("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), "value",
                F.struct("ts", "event_id"))


def bars_day(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return bars(o, F.col("o_orderpriority"), F.to_date("o_orderdate"), "o_totalprice",
                F.col("o_orderkey"))


SQL_HOUR = """bars_hour as (
  select event_type id, date_trunc('hour', ts) t, arg_min(value, (ts, event_id)) as open,
         max(value) high, min(value) low, arg_max(value, (ts, event_id)) as close,
         cast(count(*) as double) volume
  from events group by 1, 2)"""

SQL_DAY = """bars_day as (
  select o_orderpriority id, cast(o_orderdate as date) t, arg_min(o_totalprice, o_orderkey) as open,
         max(o_totalprice) high, min(o_totalprice) low, arg_max(o_totalprice, o_orderkey) as close,
         cast(count(*) as double) volume
  from orders group by 1, 2)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored articles: an embedding and three class probabilities per article."""
    e = table(spark, sf, "embeddings")
    parts = [F.abs(F.get("embedding", F.lit(i))).cast("double") for i in range(3)]
    total = parts[0] + parts[1] + parts[2]
    return e.select(
        "vec_id", F.expr("date_add(date'2024-01-01', cast(vec_id * vec_id % 61 as int))").alias("date"),
        "embedding", *[(p / total).alias(c) for p, c in
                       zip(parts, ("prob_positive", "prob_negative", "prob_neutral"))])


_S = "(abs(cast(embedding[1] as double)) + abs(cast(embedding[2] as double)) + abs(cast(embedding[3] as double)))"
SQL_SCORED = f"""scored as (
  select vec_id, date '2024-01-01' + cast(vec_id * vec_id % 61 as int) date, embedding,
    abs(cast(embedding[1] as double)) / {_S} prob_positive,
    abs(cast(embedding[2] as double)) / {_S} prob_negative,
    abs(cast(embedding[3] as double)) / {_S} prob_neutral
  from embeddings)"""
