"""Arithmetic whose missing-value and zero-division rules are fixed once, here."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def total(value: Column | str) -> Column:
    """Sum in which an all-missing group totals 0 instead of NULL."""
    return F.coalesce(F.sum(as_column(value)), F.lit(0))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double; NULL when the bottom is 0 (never Infinity)."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def mean(value: Column | str) -> Column:
    """Mean of the non-missing values.

    The sum stays in the input type, so decimal money adds up exactly and the
    result does not depend on the order in which tasks finish.
    """
    column = as_column(value)
    return ratio(F.sum(column), F.count(column))


def rate(condition: Column) -> Column:
    """Share of rows meeting ``condition``; a missing condition counts as not met."""
    return ratio(F.count(F.when(condition, 1)), F.count(F.lit(1)))


def percent_change(value: Column, over: WindowSpec) -> Column:
    """Change against the previous row of ``over``, in percent."""
    before = F.lag(value).over(over)
    return ratio(value - before, before) * 100


def share(value: Column, *within: str) -> Column:
    """``value`` as a fraction of its total inside ``within``.

    Meant for tables that are already aggregated: the window then holds one row
    per group, not one per order line.
    """
    return ratio(value, F.sum(value).over(Window.partitionBy(*within)))


def nan_to_null(value: Column) -> Column:
    """NaN means "missing" in the source data, but compares as the largest number in Spark."""
    return F.when(~F.isnan(value), value)


def to_millions(value: Column) -> Column:
    return value.cast("double") / 1_000_000


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)
