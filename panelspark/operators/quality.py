"""Data-quality rules. All row rules of one table are conditional sums of one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.arrays import bind
from panelspark.operators.segments import full_frame, rolled
from panelspark.schema import PROB_LABELS, Series

FAIL, WARN = "FAIL", "WARN"
RESULT = "case string, rule string, severity string, ok boolean, n_bad bigint, n bigint"

# Names that mark a column as derived from prices.
PRICE_WORDS = ("Close", "Open", "High", "Low", "Volume", "EMA", "MACD", "RSI", "Return",
               "Volatility", "Movement")


@dataclass(frozen=True)
class Rule:
    """`bad` counts violations of one rule; `n` what was looked at."""

    name: str
    bad: Column
    severity: str = FAIL
    n: Column | None = None


def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("bigint")), F.lit(0))


def no_null(col: str, severity: str = FAIL) -> Rule:
    return Rule(f"no_null:{col}", _count(F.col(col).isNull()), severity)


def no_inf(col: str, severity: str = FAIL) -> Rule:
    x = F.col(col).cast("double")
    return Rule(f"no_inf:{col}", _count((F.abs(x) == float("inf")) | F.isnan(x)), severity)


def null_only_where(col: str, allowed: Column, name: str, severity: str = FAIL) -> Rule:
    return Rule(f"null_only_where_{name}:{col}", _count(F.col(col).isNull() & ~allowed), severity)


def in_range(col: str, lo: float, hi: float, severity: str = FAIL) -> Rule:
    return Rule(f"range:{col}", _count(~F.col(col).between(lo, hi)), severity, F.count(col))


def positive(col: str, severity: str = FAIL) -> Rule:
    return Rule(f"positive:{col}", _count(F.col(col) <= 0), severity, F.count(col))


def flag_01(col: str, severity: str = FAIL) -> Rule:
    return Rule(f"flag_01:{col}", _count(F.col(col).isNull() | ~F.col(col).isin(0, 1)), severity)


def not_constant(col: str, severity: str = WARN) -> Rule:
    flat = F.coalesce(F.stddev_samp(col), F.lit(0.0)) <= 1e-8
    return Rule(f"not_constant:{col}", flat.cast("bigint"), severity)


def label_iff_prob(label: str = "label", prob: str = "prob_positive", severity: str = FAIL) -> Rule:
    return Rule(f"label_iff_prob:{label}", _count(F.col(label).isNull() != F.col(prob).isNull()), severity)


def label_domain(label: str = "label", domain=PROB_LABELS, severity: str = FAIL) -> Rule:
    return Rule(f"label_domain:{label}", _count(~F.col(label).isin(*domain)), severity, F.count(label))


def embedding_present(col: str, where: Column, severity: str = FAIL) -> Rule:
    return Rule(f"embedding_present:{col}", _count(F.col(col).isNull() & where), severity)


def embedding_dim(col: str, dim: int, severity: str = FAIL) -> Rule:
    return Rule(f"embedding_dim:{col}", _count(F.size(col) != dim), severity, F.count(col))


def embedding_finite(col: str, severity: str = FAIL) -> Rule:
    odd = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return Rule(f"embedding_finite:{col}", _count(odd), severity, F.count(col))


def embedding_norm(col: str, floor: float = 0.01, severity: str = WARN) -> Rule:
    sq = F.aggregate(F.col(col).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    return Rule(f"embedding_norm:{col}", _count(F.sqrt(sq) <= floor), severity, F.count(col))


def indicator_ranges(prefix: str = "") -> list[Rule]:
    """The ranges every enriched panel must respect."""
    unit = [f"{f}_{p}" for p in ("dow", "month", "doy") for f in ("sin", "cos")]
    return [*[in_range(f"{prefix}{c}", -1, 1) for c in unit],
            in_range(f"{prefix}RSI", 0, 100), in_range(f"{prefix}Stoch_K", 0, 100),
            in_range(f"{prefix}Stoch_D", 0, 100), in_range(f"{prefix}Williams_R", -100, 0),
            in_range(f"{prefix}Movement", -1, 1)]


def check(df: DataFrame, rules: list[Rule], case: str) -> DataFrame:
    """One row per rule, from one scan of df."""
    one = F.count(F.lit(1))
    row = df.agg(*[F.struct(r.bad.cast("bigint").alias("n_bad"),
                            (one if r.n is None else r.n).cast("bigint").alias("n")).alias(f"r{i}")
                   for i, r in enumerate(rules)])
    out = F.array(*[F.struct(F.lit(case).alias("case"), F.lit(r.name).alias("rule"),
                             F.lit(r.severity).alias("severity"), (F.col(f"r{i}.n_bad") == 0).alias("ok"),
                             F.col(f"r{i}.n_bad").alias("n_bad"), F.col(f"r{i}.n").alias("n"))
                    for i, r in enumerate(rules)])
    return row.select(F.explode(out).alias("x")).select("x.*")


def _result(df: DataFrame, case: str, rule: str, severity: str, n_bad: Column, n: Column) -> DataFrame:
    """A one-row table of (n_bad, n) expressions as a rule result."""
    return df.select(F.lit(case).alias("case"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                     (n_bad == 0).alias("ok"), n_bad.cast("bigint").alias("n_bad"), n.cast("bigint").alias("n"))


def same_row_counts(tables: dict[str, DataFrame], case: str) -> DataFrame:
    """Every table has as many rows as the first."""
    names = list(tables)
    counts = None
    for i, n in enumerate(names):
        c = tables[n].agg(F.count(F.lit(1)).alias("c")).withColumn("i", F.lit(i))
        counts = c if counts is None else counts.unionByName(c)
    row = counts.agg((F.max("c") - F.min("c")).alias("d"), F.max("c").alias("c"))
    return _result(row, case, "same_row_counts:" + ",".join(names), FAIL, F.col("d"), F.col("c"))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], case: str) -> DataFrame:
    """The key columns hold the same values, duplicates counted, in both tables."""
    def tally(df, sign):
        return df.select(*keys, F.lit(sign).alias("_s"))
    diff = (tally(a, 1).unionByName(tally(b, -1)).groupBy(*keys)
            .agg(F.sum("_s").alias("_d"), F.count(F.lit(1)).alias("_n")))
    row = diff.agg(F.coalesce(F.sum((F.col("_d") != 0).cast("bigint")), F.lit(0)).alias("d"),
                   F.count(F.lit(1)).alias("n"))
    return _result(row, case, "same_keys:" + ",".join(keys), FAIL, F.col("d"), F.col("n"))


def unique_keys(df: DataFrame, keys: list[str], case: str) -> DataFrame:
    per = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_x"))
    row = per.agg(F.coalesce(F.sum("_x"), F.lit(0)).alias("d"), F.count(F.lit(1)).alias("n"))
    return _result(row, case, "unique:" + ",".join(keys), FAIL, F.col("d"), F.col("n"))


def monotonic(df: DataFrame, keys: list[str], seq: str, t: str, case: str) -> DataFrame:
    """In ingest order, time never steps back."""
    x = rolled(df.select(*keys, seq, t), Series(tuple(keys), seq),
               lambda w: {"_p": F.lag(t, 1).over(w)}, back=1)
    row = x.agg(_count(F.col("_p") > F.col(t)).alias("d"), F.count(F.lit(1)).alias("n"))
    return _result(row, case, f"monotonic:{t}", FAIL, F.col("d"), F.col("n"))


def same_values(a: DataFrame, b: DataFrame, keys: list[str], col: str, case: str,
                where: Column | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Two variants agree on their common keys (for instance on trading days)."""
    a = a.filter(where) if where is not None else a
    j = a.select(*keys, F.col(col).alias("_a")).join(b.select(*keys, F.col(col).alias("_b")), keys)
    row = j.agg(_count(F.abs(F.col("_a") - F.col("_b")) >= tolerance).alias("d"), F.count(F.lit(1)).alias("n"))
    return _result(row, case, f"same_values:{col}", FAIL, F.col("d"), F.col("n"))


def schema_checks(spark, df: DataFrame, case: str, required=(), forbidden=(),
                  no_price_columns: bool = False) -> DataFrame:
    """Rules that need only the schema: required, forbidden and price-derived columns."""
    have = set(df.columns)
    rows = [(case, f"has_column:{c}", FAIL, c in have, int(c not in have), 1) for c in required]
    rows += [(case, f"lacks_column:{c}", FAIL, c not in have, int(c in have), 1) for c in forbidden]
    if no_price_columns:
        leaky = [c for c in df.columns if c != "trading_day"
                 and any(w.lower() in c.lower() for w in PRICE_WORDS)]
        rows.append((case, "no_price_derived_columns", FAIL, not leaky, len(leaky), len(df.columns)))
    return spark.createDataFrame(rows, RESULT)


def issues(results: DataFrame) -> DataFrame:
    """What failed, FAIL before WARN."""
    return results.filter(~F.col("ok")).orderBy(
        F.when(F.col("severity") == FAIL, 0).otherwise(1), "case", "rule")


def missing_report(df: DataFrame) -> DataFrame:
    """Null and non-finite counts and percentages of every column, from one scan."""
    def odd(f):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.isnan(f.name) | (F.abs(F.col(f.name)) == float("inf"))
        return F.lit(False)
    stats = [F.struct(F.lit(f.name).alias("column"), _count(F.col(f"`{f.name}`").isNull()).alias("n_null"),
                      _count(odd(f)).alias("n_not_finite"), F.count(F.lit(1)).alias("n")) for f in df.schema.fields]
    out = df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("r")).select("r.*")
    return out.withColumn("null_pct", F.try_divide(F.col("n_null") * 100.0, F.col("n")))


def spikes(df: DataFrame, s: Series, col: str, n: int = 30, threshold: float = 6.0) -> DataFrame:
    """Rows far from the rolling median, in units of the rolling median absolute deviation.

    Exact medians of the last n rows; a frame is n values, whatever the series length.
    """
    def median(a):
        return bind(F.array_sort(a), lambda x: (F.get(x, F.lit((n - 1) // 2)) + F.get(x, F.lit(n // 2))) / 2)
    def steps(w):
        return {"_f": F.when(F.count(col).over(full_frame(w, n)) == n, F.collect_list(col).over(full_frame(w, n)))}
    out = rolled(df, s, steps, back=n).filter(F.col("_f").isNotNull())
    both = bind(median(F.col("_f")), lambda m: F.struct(
        m.alias("median"), median(F.transform("_f", lambda v: F.abs(v - m))).alias("mad")))
    out = out.withColumn("_b", F.explode(F.array(both)))
    out = out.withColumns({"median": F.col("_b.median"), "mad": F.col("_b.mad")})
    z = F.when(F.col("mad") > 0, 0.6745 * (F.col(col) - F.col("median")) / F.col("mad"))
    return out.withColumn("robust_z", z).filter(F.abs("robust_z") > threshold).drop("_f", "_b")
