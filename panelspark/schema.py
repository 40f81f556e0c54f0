"""Schemas, the series specification and scan guards."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Series:
    """What identifies a series and what orders it.

    `key` columns name the series, `t` orders it; (key, t) is unique and neither is null.
    `bucket` is the calendar unit that cuts a long series into bounded pieces. By default a
    year for dates (<= 366 daily rows), a day for timestamps (<= 86,400 one-second bars) and a
    run of 4,096 for integers, so no piece grows with the length of the series.
    """

    key: tuple[str, ...] = ("id",)
    t: str = "t"
    bucket: str | None = None

    @property
    def keys(self) -> list[str]:
        return list(self.key)


@dataclass(frozen=True)
class DatasetSpec:
    """One dataset: the target series, the covariate series and the news topic it shares."""

    target_id: str
    covariates: tuple[str, ...] = ()
    news_topic: str | None = None
    bar_cols: tuple[str, ...] = field(default=("open", "high", "low", "close"))


class Registry:
    """Dataset specifications by key; an unknown key fails and names the known ones."""

    def __init__(self, specs: dict[str, DatasetSpec]):
        self._specs = dict(specs)

    def __getitem__(self, key: str) -> DatasetSpec:
        if key not in self._specs:
            raise KeyError(f"unknown dataset {key!r}; known: {', '.join(sorted(self._specs))}")
        return self._specs[key]


BARS = T.StructType([
    T.StructField("Date", T.DateType()),
    T.StructField("Open", T.DoubleType()),
    T.StructField("High", T.DoubleType()),
    T.StructField("Low", T.DoubleType()),
    T.StructField("Close", T.DoubleType()),
    T.StructField("Volume", T.DoubleType()),
])

ARTICLE = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("headline", T.StructType([T.StructField("main", T.StringType())])),
    T.StructField("byline", T.StructType([T.StructField("original", T.StringType())])),
    T.StructField("pub_date", T.StringType()),
    T.StructField("news_desk", T.StringType()),
    T.StructField("section_name", T.StringType()),
    T.StructField("document_type", T.StringType()),
    T.StructField("type_of_material", T.StringType()),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("web_url", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
    ]))),
])

STUDY_RECORD = T.StructType([
    T.StructField("window", T.IntegerType()),
    T.StructField("base_crps", T.DoubleType()),
    T.StructField("spearman", T.DoubleType()),
    T.StructField("jaccard", T.DoubleType()),
    T.StructField("ks", T.ArrayType(T.IntegerType())),
    T.StructField("del_curve", T.ArrayType(T.DoubleType())),
    T.StructField("del_curve_rand", T.ArrayType(T.DoubleType())),
    T.StructField("del_curve_inv", T.ArrayType(T.DoubleType())),
    T.StructField("ins_curve", T.ArrayType(T.DoubleType())),
    T.StructField("placebo", T.MapType(T.StringType(), T.DoubleType())),
])

# Class order that decides ties, and the matching probability columns.
PROB_LABELS = ("positive", "negative", "neutral")
PROB_COLS = ("prob_positive", "prob_negative", "prob_neutral")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column; both mean "missing" in the source files."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
    return df.withColumns(out) if out else df


def numeric_only(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns that are not scalar numbers, keeping the named ones (ids, time)."""
    cols = [f.name for f in df.schema.fields
            if f.name in keep or isinstance(f.dataType, T.NumericType)]
    return df.select(*cols)
