"""Array expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it in `body`.

    A column used inside a lambda is inlined by the optimizer and evaluated for every element;
    a one-element transform keeps it out of the inner loop.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a) -> Column:
    """Sum of an array of numbers."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
