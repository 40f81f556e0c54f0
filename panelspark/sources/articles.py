"""Articles from landing-zone JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.schema import ARTICLE


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Nested article JSON, one object per line, with the file's batch month when the path has one."""
    df = spark.read.schema(ARTICLE).json(path)
    return df.withColumn("batch_month", F.regexp_extract(F.col("_metadata.file_path"),
                                                         r"(\d{4}[-_]\d{2})", 1))


def latest_batch(df: DataFrame, day: str = "date", batch: str = "batch_month") -> DataFrame:
    """A day that two monthly batches carry keeps only the later batch's articles."""
    last = df.groupBy(day).agg(F.max(batch).alias(batch))
    return df.join(last, [day, batch], "left_semi")


def flatten_articles(df: DataFrame) -> DataFrame:
    """The metadata fields that travel with an article."""
    return df.select(
        F.col("_id").alias("id"), "web_url", F.col("headline.main").alias("headline"),
        F.col("byline.original").alias("byline"), "pub_date", "news_desk", "section_name",
        "document_type", "type_of_material", "word_count", "source", "abstract", "keywords",
        *[c for c in df.columns if c == "batch_month"])
