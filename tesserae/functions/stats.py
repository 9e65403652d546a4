"""Aggregates whose definitions differ in detail; percentiles are in operators.selection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cv_percent(value: Column) -> Column:
    """100 * population deviation / mean; 0 where the mean is 0."""
    return F.when(F.avg(value) == 0, F.lit(0.0)).otherwise(100 * F.stddev_pop(value) / F.avg(value))


def geomean(value: Column) -> Column:
    """Over positive values; null without any."""
    return F.exp(F.avg(F.when(value > 0, F.ln(value))))


def is_constant(value: Column) -> Column:
    """Exact zero variance: rounding can leave a population deviation of a constant group above 0."""
    return F.min(value) == F.max(value)


def not_false(flag: Column) -> Column:
    """True for true and for unknown."""
    return ~flag.eqNullSafe(False)


def share(predicate: Column) -> Column:
    return F.avg(F.coalesce(predicate, F.lit(False)).cast("double"))


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
