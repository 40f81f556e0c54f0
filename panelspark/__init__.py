"""Panels of time series joined with daily text signals, as Spark DataFrame operators."""

from panelspark.schema import Series
from panelspark.session import build_session

__all__ = ["Series", "build_session"]
