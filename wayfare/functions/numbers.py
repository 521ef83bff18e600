"""Rounding rules of the exported tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """Halves towards plus infinity, also for negative numbers."""
    f = float(10**digits)
    return F.floor(x * f + 0.5).cast("double") / f


def finite(x: Column) -> Column:
    """Null instead of NaN or an infinity."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def fmt(pattern: str, c: Column | str) -> Column:
    """A number as text, null for null (the formatter itself would print one)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNotNull(), F.format_string(pattern, col))
