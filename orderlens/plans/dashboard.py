"""Tables behind the dashboard pages that are not analyses of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.delivery import average_days
from orderlens.functions.numeric import mean, ratio, total
from orderlens.functions.text import plain_price
from orderlens.operators.frames import (
    between_dates,
    product_column,
    top_rows,
    value_counts,
    with_keys,
)
from orderlens.operators.histogram import histogram
from orderlens.operators.periods import resample
from orderlens.operators.quantiles import describe
from orderlens.plans.revenue import revenue_by

# Fixed values
SLOWEST_ROWS = 200
PRICED_PRODUCTS = 200
DELIVERY_LIMITS = (1, 2, 3)
UNKNOWN_STATUS = "unknown"


def kpis(sales: DataFrame, start=None, end=None, value_over: str = "rows") -> DataFrame:
    """Rows, revenue and mean order value (0 when there are no rows) in a date range.

    ``value_over``: 'rows' divides by all rows, 'amounts' by those that have an amount.
    """
    if start is not None:
        sales = between_dates(sales, start, end)
    over = {"rows": F.count(F.lit(1)), "amounts": F.count("final_amount")}[value_over]
    counted = sales.agg(
        F.count(F.lit(1)).alias("orders"), total("final_amount").alias("revenue"), over.alias("_over")
    )
    value = F.coalesce(ratio(F.col("revenue"), F.col("_over")), F.lit(0.0))
    return counted.withColumn("average_order_value", value).drop("_over")


def trend(sales: DataFrame, period: str = "M") -> DataFrame:
    return resample(sales, period)


def top_products(sales: DataFrame, n: int = 10) -> DataFrame:
    product = product_column(sales)
    return top_rows(revenue_by(sales, product), n, "revenue", product)


def product_table(sales: DataFrame, n: int = 15, price: str = "final_amount") -> DataFrame:
    """Distinct orders, revenue and mean price of the best products."""
    product = product_column(sales)
    grouped = (
        with_keys(sales, product)
        .groupBy(product)
        .agg(
            F.count_distinct("transaction_id").alias("orders"),
            total("final_amount").alias("revenue"),
            mean(price).alias("average_price"),
        )
    )
    return top_rows(grouped, n, "revenue", product)


def one_product(sales: DataFrame, name: str) -> DataFrame:
    return sales.where(F.col(product_column(sales)) == name)


def product_totals(sales: DataFrame, name: str) -> DataFrame:
    return one_product(sales, name).agg(
        total("final_amount").alias("revenue"),
        F.count_distinct("transaction_id").alias("orders"),
        total("quantity").alias("quantity"),
    )


def product_trend(sales: DataFrame, name: str, period: str = "M") -> DataFrame:
    return resample(one_product(sales, name), period).drop("orders")


def product_price_summary(sales: DataFrame, name: str, price: str = "final_amount") -> DataFrame:
    return describe(one_product(sales, name), plain_price(F.col(price)))


def product_price_histogram(
    sales: DataFrame, name: str, price: str = "final_amount", bins: int = 40
) -> DataFrame:
    return histogram(one_product(sales, name), plain_price(F.col(price)), bins)


def price_and_revenue(
    sales: DataFrame, price: str = "final_amount", n: int = PRICED_PRODUCTS
) -> DataFrame:
    """Mean price, revenue and rows of the best products that have a price."""
    product = product_column(sales)
    grouped = (
        with_keys(sales, product)
        .groupBy(product)
        .agg(
            mean(plain_price(F.col(price))).alias("average_price"),
            total("final_amount").alias("revenue"),
            F.count("order_date").alias("orders"),
        )
    )
    return top_rows(with_keys(grouped, "average_price"), n, "revenue", product)


def with_parsed_delivery(sales: DataFrame, text: str = "delivery_text") -> DataFrame:
    return sales.withColumn("parsed_days", average_days(F.col(text)))


def delivery_coverage(sales: DataFrame, text: str = "delivery_text") -> DataFrame:
    """Rows, rows with a readable delivery time, rows within 1, 2 and 3 days."""
    days = F.col("parsed_days")
    return with_parsed_delivery(sales, text).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(days).alias("parsed"),
        *[F.count_if(days <= limit).alias(f"within_{limit}") for limit in DELIVERY_LIMITS],
    )


def delivery_summary(sales: DataFrame, text: str = "delivery_text") -> DataFrame:
    return describe(with_parsed_delivery(sales, text), "parsed_days")


def delivery_histogram(
    sales: DataFrame, text: str = "delivery_text", bins: int = 30
) -> DataFrame:
    return histogram(with_parsed_delivery(sales, text), "parsed_days", bins)


def slowest_deliveries(
    sales: DataFrame, *ties: str, text: str = "delivery_text", n: int = SLOWEST_ROWS
) -> DataFrame:
    parsed = with_parsed_delivery(sales, text).where(F.col("parsed_days").isNotNull())
    return top_rows(parsed, n, "parsed_days", *(ties or ("order_date", "transaction_id")))


def status_counts(sales: DataFrame) -> DataFrame:
    return value_counts(sales, "return_status", missing=UNKNOWN_STATUS)
