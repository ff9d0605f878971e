"""Price, discount, demand and competition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.bins import DISCOUNT_LABELS, discount_bin
from orderlens.functions.dates import month_start
from orderlens.functions.numeric import mean, share, total
from orderlens.operators.frames import complete_grid, matrix_cells, with_keys
from orderlens.operators.histogram import histogram
from orderlens.operators.quantiles import box_stats, trim_above
from orderlens.operators.statistics import correlation_matrix


def charged_price() -> Column:
    """Discounted price, or the original one where there is no discount."""
    return F.coalesce("discounted_price", "original_price")


def price_demand(sales: DataFrame) -> DataFrame:
    """Mean price and discount, quantity and revenue per subcategory."""
    return (
        with_keys(sales, "subcategory")
        .groupBy("subcategory")
        .agg(
            mean(charged_price()).alias("average_price"),
            total("quantity").alias("quantity"),
            mean("discount_percent").alias("average_discount"),
            total("final_amount").alias("revenue"),
        )
    )


def price_correlation(sales: DataFrame) -> DataFrame:
    """Correlation of price, discount, quantity and revenue over rows."""
    priced = sales.select(
        charged_price().alias("price"), "discount_percent", "quantity", "final_amount"
    )
    return correlation_matrix(priced, ["price", "discount_percent", "quantity", "final_amount"])


def with_discount_bin(sales: DataFrame) -> DataFrame:
    return sales.withColumn("discount_bin", discount_bin(F.col("discount_percent")))


def discount_by_year(sales: DataFrame) -> DataFrame:
    """Quantity and revenue per year and discount bin, all bins listed for every year."""
    binned = with_discount_bin(with_keys(sales, "order_year"))
    totals = binned.groupBy("order_year", "discount_bin").agg(
        total("quantity").alias("quantity"), total("final_amount").alias("revenue")
    )
    bins = F.array(*[F.lit(label) for label in DISCOUNT_LABELS])
    return complete_grid(totals, "order_year", "discount_bin", bins, {"quantity": 0, "revenue": 0})


def discount_over_time(sales: DataFrame) -> DataFrame:
    """Mean discount, quantity and revenue per month and subcategory."""
    keys = ["order_year", "order_month", "subcategory"]
    return (
        with_keys(sales, *keys)
        .groupBy(*keys)
        .agg(
            mean("discount_percent").alias("average_discount"),
            total("quantity").alias("quantity"),
            total("final_amount").alias("revenue"),
        )
        .withColumn("month_start", month_start(F.col("order_year"), F.col("order_month")))
    )


def discount_quantity(sales: DataFrame) -> DataFrame:
    """Mean quantity per row by discount bin and subcategory."""
    keys = ["discount_bin", "subcategory"]
    return (
        with_keys(with_discount_bin(sales), *keys)
        .groupBy(*keys)
        .agg(mean("quantity").alias("average_quantity"))
    )


def discount_revenue_box(sales: DataFrame) -> DataFrame:
    """Box statistics of the row amount by discount bin and subcategory."""
    return box_stats(with_discount_bin(sales), "final_amount", ["discount_bin", "subcategory"])


def discount_correlation(sales: DataFrame) -> DataFrame:
    """Correlation of discount, quantity and revenue over subcategories."""
    grouped = (
        with_keys(sales, "subcategory")
        .groupBy("subcategory")
        .agg(
            mean("discount_percent").alias("average_discount"),
            total("quantity").alias("quantity"),
            total("final_amount").alias("revenue"),
        )
    )
    return correlation_matrix(grouped, ["average_discount", "quantity", "revenue"])


def competitive_prices(sales: DataFrame, trim: float = 0.99) -> DataFrame:
    """Rows whose amount is positive and below the given quantile of all amounts."""
    return trim_above(sales, "final_amount", trim)


def brand_price_histogram(sales: DataFrame, bins: int = 30) -> DataFrame:
    """Price histogram of each brand in each subcategory."""
    return histogram(competitive_prices(sales), "final_amount", bins, ["subcategory", "brand"])


def brand_position(sales: DataFrame) -> DataFrame:
    """Quantity, mean price and share of the subcategory's quantity per brand."""
    keys = ["subcategory", "brand"]
    grouped = (
        with_keys(competitive_prices(sales), *keys)
        .groupBy(*keys)
        .agg(total("quantity").alias("quantity"), mean("final_amount").alias("average_price"))
    )
    whole = F.sum("quantity").over(Window.partitionBy("subcategory"))
    return grouped.withColumn("category_quantity", whole).withColumn(
        "market_share", share(F.col("quantity"), "subcategory")
    )


def brand_matrix(sales: DataFrame, value: str) -> DataFrame:
    """Every brand in every subcategory, 0 where a brand is absent; ``value``: market_share or
    average_price."""
    return matrix_cells(brand_position(sales), "brand", "subcategory", value, 0.0)
