"""Brand performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.dates import month_start
from orderlens.functions.numeric import ratio, total
from orderlens.operators.frames import with_keys
from orderlens.plans.revenue import revenue_by


def brand_performance(sales: DataFrame) -> DataFrame:
    """Revenue, quantity and market share in percent per brand."""
    brands = (
        with_keys(sales, "brand")
        .groupBy("brand")
        .agg(total("final_amount").alias("revenue"), total("quantity").alias("quantity"))
    )
    everything = brands.agg(F.sum("revenue").alias("r")).scalar()
    percent = ratio(F.col("revenue"), F.col("_all")) * 100
    return brands.withColumn("_all", everything).select(
        "brand", "revenue", "quantity", percent.alias("market_share")
    )


def brand_by_month(sales: DataFrame) -> DataFrame:
    monthly = revenue_by(sales, "order_year", "order_month", "brand")
    start = month_start(F.col("order_year"), F.col("order_month"))
    return monthly.withColumn("month_start", start)


def brand_by_category(sales: DataFrame, top: int | None = None) -> DataFrame:
    """Revenue per subcategory and brand; with ``top`` only the best brands of each subcategory."""
    totals = revenue_by(sales, "subcategory", "brand")
    if top is None:
        return totals
    best = Window.partitionBy("subcategory").orderBy(F.col("revenue").desc(), "brand")
    return totals.withColumn("_place", F.row_number().over(best)).where(
        F.col("_place") <= top
    ).drop("_place")
