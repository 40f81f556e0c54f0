"""Calendar encodings and month arithmetic."""

from __future__ import annotations

import calendar
import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Periods of the encodings; a year counts 365 days also in leap years.
PERIODS = {"dow": 7, "month": 12, "doy": 365}


def calendar_features(t: str) -> dict[str, Column]:
    """sin/cos of weekday (Monday = 0), month and day of year."""
    day = F.to_date(t)
    phase = {"dow": F.weekday(day), "month": F.month(day), "doy": F.dayofyear(day)}
    out = {}
    for name, x in phase.items():
        angle = x * (2 * math.pi / PERIODS[name])
        out[f"sin_{name}"], out[f"cos_{name}"] = F.sin(angle), F.cos(angle)
    return out


def last_complete_month(today: dt.date) -> tuple[int, int]:
    """(year, month) of the last month that has fully passed."""
    end = today.replace(day=1) - dt.timedelta(days=1)
    return end.year, end.month


def months(start_year: int, end: tuple[int, int]) -> list[tuple[int, int]]:
    """All (year, month) from January of `start_year` to `end`, inclusive."""
    last = end[0] * 12 + end[1] - 1
    return [(m // 12, m % 12 + 1) for m in range(start_year * 12, last + 1)]


def month_end(year: int, month: int) -> dt.date:
    return dt.date(year, month, calendar.monthrange(year, month)[1])


def month_table(spark, start: dt.date, end: dt.date):
    """One row per month between two dates: first day and last day."""
    m = spark.range(1).select(F.explode(F.expr(
        f"sequence(trunc(date'{start}','month'), trunc(date'{end}','month'), interval 1 month)"))
        .alias("month_start"))
    return m.withColumn("month_end", F.last_day("month_start"))
