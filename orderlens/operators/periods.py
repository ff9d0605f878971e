"""Totals per calendar period, with empty periods filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import total

# Period code -> (truncation unit, length in months).
PERIODS = {"M": ("month", 1), "Q": ("quarter", 3), "Y": ("year", 12)}


def resample(
    df: DataFrame, period: str, date: str = "order_date", value: str = "final_amount"
) -> DataFrame:
    """``period_end, revenue, orders`` for every period between the first and the last one.

    The label is the last day of the period. The calendar spine is unfolded from
    the range of the grouped result, so its size depends on the calendar only.
    """
    unit, _ = PERIODS[period]
    totals = (
        df.where(F.col(date).isNotNull())
        .groupBy(F.trunc(date, unit).alias("_start"))
        .agg(total(value).alias("revenue"), F.count(F.lit(1)).alias("orders"))
    )
    return with_empty_periods(totals, period)


def with_empty_periods(totals: DataFrame, period: str) -> DataFrame:
    """``period_end, revenue, orders`` from totals per ``_start``; read twice, for the range and the rows."""
    _, months = PERIODS[period]
    step = F.make_ym_interval(F.lit(0), F.lit(months))
    spine = totals.agg(F.min("_start").alias("_a"), F.max("_start").alias("_b")).where(
        F.col("_a").isNotNull()
    )
    spine = spine.select(F.explode(F.sequence("_a", "_b", step)).alias("_start"))
    return spine.join(totals, "_start", "left").select(
        F.date_sub(F.add_months("_start", months), 1).alias("period_end"),
        F.coalesce("revenue", F.lit(0)).alias("revenue"),
        F.coalesce("orders", F.lit(0)).alias("orders"),
    )
