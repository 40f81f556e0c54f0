"""Session defaults and the one place that decides where intermediate tables go."""

from __future__ import annotations

import functools
import os
import threading
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ship_lock = threading.Lock()

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "panelspark", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with UTC time, adaptive execution and dynamic partition overwrite, and the package on its workers."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def local_conf(cpus: int | str = 8) -> dict[str, str]:
    """Settings for one machine and small tables: as many shuffle partitions as cores, kept apart
    even when small, because the work per row is high."""
    return {"spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.driver.memory": "8g"}


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a context, so that functions named in it resolve there.

    The archive lies in the driver's own Spark folder; executors fetch it from the driver, also those
    that join later.
    """
    context = spark.sparkContext
    with _ship_lock:
        if getattr(context, "_panelspark_shipped", False):
            return
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(context._temp_dir, "panelspark.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "panelspark")):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, root))
        context.addPyFile(archive)
        context._panelspark_shipped = True


def shipped(fn: Callable) -> Callable:
    """A query that ships the package before it plans anything."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf)
    return run


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir`, else the warehouse.

    Whether executors share the warehouse is up to the cluster; set `spark.checkpoint.dir` where they do not.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_panelspark_stage")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table once and read it back.

    Used where several operators branch off one expensive aggregate: the branches then scan a
    small parquet table instead of re-reading the raw events, and a lost executor costs one
    file read, not the whole lineage.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
