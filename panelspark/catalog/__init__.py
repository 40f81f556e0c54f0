"""Registered queries over the driver tables, each with its SQL equivalent where one exists."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MODULES = ["indicators", "alignment", "news", "windows", "statistics", "evaluation",
           "saliency", "quality", "streams", "storage", "flows"]


def query(name: str, sql: str | None = None, time: str = ""):
    """Register a query under a name; `sql` is what DuckDB runs on the same tables.

    `time` names the date and timestamp columns of the result. Both engines hand them out as
    text, because their client libraries represent dates differently.
    """
    cols = time.split()

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(spark, sf).withColumns(
                {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})

        QUERIES[name] = run if cols else fn
        if sql is not None:
            text = ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}" for c in cols)
            ORACLE[name] = f"select * replace ({text}) from (\n{sql}\n) result" if cols else sql
        return fn
    return add


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"panelspark.catalog.{m}")
