"""Guarded arithmetic of the trend metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_share(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, ``0.0`` when there is nothing to share."""
    whole = F.coalesce(whole, F.lit(0))
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        F.coalesce(part, F.lit(0)).cast("double") / whole.cast("double")
    )


def growth_pct(current: Column, previous: Column) -> Column:
    """Growth in percent; null when the base is null or zero."""
    return F.when(previous.isNotNull() & (previous != 0), (current - previous) / previous * 100)


def abs_diff(left: Column, right: Column) -> Column:
    return F.abs(F.coalesce(left, F.lit(0)) - F.coalesce(right, F.lit(0)))


def pct_diff(value: Column, base: Column) -> Column:
    """Absolute difference in percent of ``base``; null when ``base`` is null or zero."""
    base_or_zero = F.coalesce(base, F.lit(0))
    difference = abs_diff(value, base).cast("double")
    return F.when(base_or_zero != 0, difference * 100.0 / base_or_zero.cast("double"))
