"""Bars from events, from per-ticker CSV folders, from messy CSV and from parquet panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.schema import BARS, nan_to_null


def bars(events: DataFrame, id_: Column, t: Column, value: str, order: Column) -> DataFrame:
    """Open, high, low, close and count per (id, t); `order` ranks events within a bar.

    All five are partial aggregates, so a busy id shrinks to one row per bar before the shuffle.
    """
    v = F.col(value)
    return (events.groupBy(id_.alias("id"), t.alias("t"))
            .agg(F.min_by(v, order).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"),
                 F.max_by(v, order).alias("close"),
                 F.count(F.lit(1)).cast("double").alias("volume")))


def _files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Names in a folder, through Hadoop so any file system works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p)
            if st.getPath().getName().lower().endswith(suffix)]


def read_bars(spark: SparkSession, path: str, schema: T.StructType = BARS) -> DataFrame:
    """A folder of per-ticker CSV files; the file stem is the id, other files are ignored."""
    if not _files(spark, path, ".csv"):
        raise FileNotFoundError(f"no bar CSV files in {path}")
    df = (spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv")
          .csv(path))
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    df = df.withColumn("id", F.url_decode(stem))
    return nan_to_null(df.select("id", *[F.col(c).alias(_bar_name(c)) for c in schema.names]))


def _bar_name(c: str) -> str:
    return "t" if c.lower() == "date" else c.lower()


def read_messy_bars(spark: SparkSession, path: str, names: list[str],
                    required: list[str]) -> DataFrame:
    """CSV with junk leading lines and forced names: unparsable cells become null, rows that
    lack a required cell are dropped."""
    strings = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(strings).option("header", False).option("mode", "PERMISSIVE").csv(path)
    casts = {n: (F.col(n).try_cast("date") if n.lower() == "date" else F.col(n).try_cast("double"))
             for n in names}
    # junk and header lines do not parse as data, so the required cells are null there
    return nan_to_null(df.withColumns(casts)).dropna("any", subset=required)


def read_panel(spark: SparkSession, path: str, ids: list[str] | None = None,
               features: list[str] | None = None, key: str = "id", t: str = "date") -> DataFrame:
    """Only the requested columns and ids; both reach the parquet scan."""
    df = spark.read.parquet(path)
    if features is not None:
        df = df.select(t, key, *features)
    return df.filter(F.col(key).isin(ids)) if ids is not None else df


def parse_vector(col: str, to: str = "array<double>") -> Column:
    """A vector stored as the text of a list."""
    return F.from_json(F.col(col), to)
