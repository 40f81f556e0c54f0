"""Looking at tables and checking that inputs exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require(spark: SparkSession, path: str, producer: str) -> None:
    """Fail before planning when an input is missing, naming the step that makes it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"{path} is missing; run {producer} first")


def inspect_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of each table: position, type, row count, first value.

    Arrays show their length. Every table is read once for its count and once for one row.
    """
    out = None
    for name, df in tables.items():
        shown = [(F.concat(F.lit("size "), F.size(f.name)) if isinstance(f.dataType, T.ArrayType)
                  else F.col(f.name).cast("string")).alias(f.name) for f in df.schema.fields]
        first = df.limit(1).select(F.array(*[F.coalesce(c, F.lit("null")) for c in shown]).alias("v"))
        rows = df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows").scalar()
        info = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                                  F.lit(f.dataType.simpleString()).alias("type"))
                         for i, f in enumerate(df.schema.fields)])
        one = first.select(F.posexplode(info).alias("p", "i"), "v").select(
            F.lit(name).alias("table"), "i.*", F.element_at("v", F.col("p") + 1).alias("first_value"),
            rows.alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out
