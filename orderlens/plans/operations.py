"""Delivery times, ratings and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import mean, rate
from orderlens.operators.frames import keep_members, top_rows, with_keys
from orderlens.operators.quantiles import box_stats, fill_with_median
from orderlens.operators.statistics import correlation_matrix

# Fixed values
ON_TIME_DAYS = 5
TOP_CITIES = 10
RETURNED = "Returned"


def returned() -> Column:
    """A missing status counts as not returned."""
    return F.coalesce(F.col("return_status") == RETURNED, F.lit(False))


def rated_deliveries(sales: DataFrame, fill_days: bool = False) -> DataFrame:
    """Rows with delivery days and a customer rating.

    With ``fill_days`` missing days take the median instead of dropping the row.
    """
    if fill_days:
        return fill_with_median(sales, "delivery_days").where(F.col("customer_rating").isNotNull())
    return with_keys(sales, "delivery_days", "customer_rating")


def busiest_cities(deliveries: DataFrame, n: int = TOP_CITIES) -> DataFrame:
    counts = (
        with_keys(deliveries, "customer_city")
        .groupBy("customer_city")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return top_rows(counts, n, "rows", "customer_city")


def in_busiest_cities(deliveries: DataFrame, n: int = TOP_CITIES) -> DataFrame:
    return keep_members(deliveries, busiest_cities(deliveries, n), "customer_city", n)


def delivery_days_by_tier(sales: DataFrame) -> DataFrame:
    return box_stats(rated_deliveries(sales), "delivery_days", ["customer_tier"], few_values=True)


def delivery_days_by_city(sales: DataFrame, n: int = TOP_CITIES) -> DataFrame:
    chosen = in_busiest_cities(rated_deliveries(sales), n)
    return box_stats(chosen, "delivery_days", ["customer_city"], few_values=True)


def _on_time(deliveries: DataFrame, key: str) -> DataFrame:
    punctual = rate(F.col("delivery_days") <= ON_TIME_DAYS) * 100
    return with_keys(deliveries, key).groupBy(key).agg(punctual.alias("on_time_percent"))


def on_time_by_tier(sales: DataFrame) -> DataFrame:
    return _on_time(rated_deliveries(sales), "customer_tier")


def on_time_by_city(sales: DataFrame, n: int = TOP_CITIES) -> DataFrame:
    return _on_time(in_busiest_cities(rated_deliveries(sales), n), "customer_city")


def _satisfaction(deliveries: DataFrame, key: str) -> DataFrame:
    return (
        with_keys(deliveries, key)
        .groupBy(key)
        .agg(
            mean("delivery_days").alias("average_days"),
            mean("customer_rating").alias("average_rating"),
        )
    )


def satisfaction_by_tier(sales: DataFrame) -> DataFrame:
    return _satisfaction(rated_deliveries(sales), "customer_tier")


def satisfaction_by_city(sales: DataFrame, n: int = TOP_CITIES) -> DataFrame:
    return _satisfaction(in_busiest_cities(rated_deliveries(sales), n), "customer_city")


def fully_rated(sales: DataFrame) -> DataFrame:
    """Rows with both ratings, and whether they were returned."""
    rated = with_keys(sales, "customer_rating", "product_rating")
    return rated.withColumn("returned", returned())


def return_rate(sales: DataFrame, *by: str) -> DataFrame:
    """Share of returned rows, overall or per key."""
    rated = with_keys(fully_rated(sales), *by)
    return rated.groupBy(*by).agg(rate(F.col("returned")).alias("return_rate"))


def return_box(sales: DataFrame, value: str) -> DataFrame:
    """Box statistics of ``value`` for returned and kept rows."""
    few = value in ("customer_rating", "product_rating")
    return box_stats(fully_rated(sales), value, ["returned"], few_values=few)


def return_correlation(sales: DataFrame) -> DataFrame:
    columns = [
        "returned",
        "customer_rating",
        "product_rating",
        "final_amount",
        "discount_percent",
        "quantity",
    ]
    rated = fully_rated(sales).withColumn("returned", F.col("returned").cast("int"))
    return correlation_matrix(rated, columns)
