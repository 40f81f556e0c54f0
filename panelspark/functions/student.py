"""Two-sided Student-t p-values for columns (vectorised; statistic tables have few rows)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def t_two_sided(stat: float, df: float) -> float:
    """P(|t| >= |stat|): the regularised incomplete beta I_x(df/2, 1/2) at x = df / (df + stat^2)."""
    if not (math.isfinite(stat) and df > 0):
        return 0.0 if math.isinf(stat) else float("nan")
    a, b, x = df / 2, 0.5, df / (df + stat * stat)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float, steps: int = 500) -> float:
    """Continued fraction of the incomplete beta, evaluated from the last term backwards."""
    value = 0.0
    for m in range(steps, 0, -1):
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = odd / (1 + even / (1 + value))
    return 1 / (1 + value)


@F.pandas_udf(T.DoubleType())
def t_p_value(stat: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np.array([t_two_sided(float(s), float(d)) for s, d in zip(stat, df)]))
