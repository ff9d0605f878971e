"""Revenue by state, city and tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import share, total
from orderlens.operators.frames import first_present, top_rows, with_keys
from orderlens.plans.revenue import revenue_by


def state_revenue(sales: DataFrame) -> DataFrame:
    return revenue_by(sales, "customer_state")


def place_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per (city, state, tier)."""
    return revenue_by(sales, "customer_city", "customer_state", "customer_tier")


def city_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per city with its most frequent tier (first in alphabet on a tie)."""
    by_tier = (
        with_keys(sales, "customer_city")
        .groupBy("customer_city", "customer_tier")
        .agg(F.count(F.lit(1)).alias("_rows"), total("final_amount").alias("_revenue"))
    )
    tier = F.col("customer_tier")
    most = F.min(F.when(tier.isNotNull(), F.struct((-F.col("_rows")).alias("n"), tier)))
    return (
        by_tier.groupBy("customer_city")
        .agg(F.sum("_revenue").alias("revenue"), most.alias("_most"))
        .where(F.col("_most").isNotNull())
        .select("customer_city", "revenue", F.col("_most.customer_tier").alias("customer_tier"))
    )


def tier_revenue_by_year(sales: DataFrame) -> DataFrame:
    return revenue_by(sales, "order_year", "customer_tier")


def latest_tier_share(sales: DataFrame) -> DataFrame:
    """Revenue and share in percent per tier in the newest year."""
    yearly = with_keys(sales, "order_year").groupBy("order_year", "customer_tier").agg(
        total("final_amount").alias("revenue")
    )
    newest = yearly.agg(F.max("order_year").alias("y")).scalar()
    latest = with_keys(yearly.where(F.col("order_year") == newest), "customer_tier")
    return latest.select(
        "customer_tier", "revenue", (share(F.col("revenue")) * 100).alias("share_percent")
    )


def top_locations(sales: DataFrame, n: int = 10) -> DataFrame:
    """Best locations by revenue; the location column is the first one the data has."""
    place = first_present(sales, "location")
    if place is None:
        raise ValueError("no location column")
    return top_rows(revenue_by(sales, place), n, "revenue", place)
