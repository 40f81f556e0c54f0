"""Sinks: panels, articles, reports and study records."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators.align import align_outer
from panelspark.schema import STUDY_RECORD


def write_long_panel(df: DataFrame, path: str, key: str = "id", t: str = "t") -> None:
    """Parquet with one folder per series; readers prune by id.

    Rows are spread by (id, year) first: few files per id, and a large series keeps many writers.
    """
    (df.repartition(key, F.year(t)).sortWithinPartitions(key, t)
     .write.mode("overwrite").partitionBy(key).parquet(path))


def write_wide_panel(df: DataFrame, path: str, ids: list[str], value: str = "close",
                     key: str = "id", t: str = "t") -> None:
    """One row per date, one column per series; the ids are named so no pass looks for them."""
    align_outer(df, ids, key, t, value).write.mode("overwrite").parquet(path)


def write_bar_files(df: DataFrame, path: str, key: str = "id") -> None:
    """A folder of one CSV file per series, named after it, as `read_bars` reads it.

    Series are written in parallel, one file each; the driver only renames the finished files.
    """
    spark = df.sparkSession
    df.repartition(key).write.mode("overwrite").option("header", True).partitionBy(key).csv(path)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if not folder.isDirectory() or "=" not in name:
            continue
        for part in fs.listStatus(folder.getPath()):
            if part.getPath().getName().endswith(".csv"):
                series = unquote(name.split("=", 1)[1])
                if not fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(root, f"{series}.csv")):
                    raise OSError(f"cannot name the file of {series}")
        fs.delete(folder.getPath(), True)


def write_articles_json(df: DataFrame, path: str, day: str = "date") -> None:
    """JSON by day; writing a day again replaces that day only."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(day).json(path))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row nested summary as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType = STUDY_RECORD) -> DataFrame:
    return spark.read.schema(schema).json(path)


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units of work that the output table does not hold yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")
