"""Revenue over time: trend, growth and season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.dates import month_label, month_name
from orderlens.functions.numeric import percent_change, share, to_millions, total
from orderlens.operators.frames import to_wide, with_keys
from orderlens.operators.statistics import linear_trend


def revenue_by(sales: DataFrame, *keys: str, amount: str = "final_amount") -> DataFrame:
    return with_keys(sales, *keys).groupBy(*keys).agg(total(amount).alias("revenue"))


def yearly_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per year with growth over the previous year in percent."""
    # One row per calendar year: the ordered window is over a handful of rows.
    growth = percent_change(F.col("revenue"), Window.orderBy("order_year"))
    return revenue_by(sales, "order_year").withColumn("yoy_percent", growth)


def revenue_trend(sales: DataFrame) -> DataFrame:
    """Slope and intercept of the straight line through the yearly revenues."""
    return linear_trend(revenue_by(sales, "order_year"), "order_year", "revenue")


def monthly_revenue(sales: DataFrame) -> DataFrame:
    return revenue_by(sales, "order_year", "order_month")


def revenue_heatmap(sales: DataFrame, millions: bool = False) -> DataFrame:
    """Year by month, one column per month; months without sales stay missing in millions, else 0."""
    long = monthly_revenue(sales)
    if millions:
        long = long.withColumn("revenue", to_millions(F.col("revenue")))
    return to_wide(
        long, "order_year", "order_month", "revenue", range(1, 13), "m", None if millions else 0
    )


def month_totals(sales: DataFrame) -> DataFrame:
    """Revenue per month of the year over all years, with the month's name."""
    totals = revenue_by(sales, "order_month")
    return totals.withColumn("month_name", month_name(F.col("order_month")))


def _peak(value: Column, month: Column) -> Column:
    """Month with the highest value, the earliest one if several tie."""
    return F.max_by(month, F.struct(value, -month))


def peak_month(sales: DataFrame) -> DataFrame:
    return (
        revenue_by(sales, "order_month")
        .agg(
            _peak(F.col("revenue"), F.col("order_month")).alias("order_month"),
            F.max("revenue").alias("revenue"),
        )
        .withColumn("month_name", month_name(F.col("order_month")))
    )


def category_month_share(sales: DataFrame) -> DataFrame:
    """Each month's part of its category's revenue."""
    totals = revenue_by(sales, "category", "order_month")
    return totals.withColumn("normalized_sales", share(F.col("revenue"), "category"))


def category_peak_month(sales: DataFrame) -> DataFrame:
    return (
        revenue_by(sales, "category", "order_month")
        .groupBy("category")
        .agg(
            _peak(F.col("revenue"), F.col("order_month")).alias("order_month"),
            F.max("revenue").alias("revenue"),
        )
        .withColumn("month_name", month_name(F.col("order_month")))
    )


def month_summary(sales: DataFrame, date: str = "order_date") -> DataFrame:
    """Revenue per calendar month present in the data, labelled yyyy-MM."""
    labelled = sales.select(month_label(F.col(date)).alias("period_month"), "final_amount")
    return revenue_by(labelled, "period_month")
