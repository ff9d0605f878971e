"""Product launch, growth and decline.

Input is expected without repeated rows; ``operators.frames.distinct_rows`` removes
them. Rows shrink to one per product and month before a whole product is
looked at, so a product with very many rows costs no more than its months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.dates import month_number
from orderlens.functions.numeric import mean, ratio, total
from orderlens.operators.frames import with_keys
from orderlens.operators.sequences import is_declining, rolling_mean
from orderlens.operators.skew import attach
from orderlens.plans.operations import returned

# Fixed values
LAUNCH_LAST_MONTH = 3  # launch success looks at months 0..3
EARLY_LAST_MONTH = 2  # early sales look at months 0..2
ROLLING_ROWS = 3
DECLINE_PERIODS = 5


def months_since_launch(sales: DataFrame) -> DataFrame:
    """Every row with its product's first day of sale and the calendar months since."""
    launches = (
        with_keys(sales, "product_id")
        .groupBy("product_id")
        .agg(F.min("order_date").alias("launch_date"), F.count(F.lit(1)).alias("_rows"))
    )
    dated = attach(sales, launches, ["product_id"], "_rows")
    months = month_number(F.col("order_date")) - month_number(F.col("launch_date"))
    return dated.withColumn("months_since_launch", months)


def quantity_by_year(sales: DataFrame) -> DataFrame:
    keys = ["subcategory", "order_year"]
    return with_keys(sales, *keys).groupBy(*keys).agg(total("quantity").alias("quantity"))


def product_quantity_by_year(sales: DataFrame) -> DataFrame:
    keys = ["product_id", "subcategory", "order_year"]
    return with_keys(sales, *keys).groupBy(*keys).agg(total("quantity").alias("quantity"))


def _since_launch(monthly: DataFrame) -> DataFrame:
    launch = F.min("_month").over(Window.partitionBy("product_id"))
    return monthly.withColumn("_age", F.col("_month") - launch)


def launch_success(sales: DataFrame) -> DataFrame:
    """Quantity, mean rating and return rate of each product in its first months (0..3)."""
    monthly = (
        with_keys(sales, "product_id", "order_date")
        .groupBy("product_id", month_number(F.col("order_date")).alias("_month"))
        .agg(
            total("quantity").alias("quantity"),
            F.sum("customer_rating").alias("_rating"),
            F.count("customer_rating").alias("_rated"),
            F.count_if(returned()).alias("_returned"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    return (
        _since_launch(monthly)
        .where(F.col("_age") <= LAUNCH_LAST_MONTH)
        .groupBy("product_id")
        .agg(
            F.sum("quantity").alias("launch_quantity"),
            ratio(F.sum("_rating"), F.sum("_rated")).alias("average_rating"),
            ratio(F.sum("_returned"), F.sum("_rows")).alias("return_rate"),
        )
    )


def early_quantity(sales: DataFrame) -> DataFrame:
    """Mean quantity a product sells in months 0..2, per subcategory.

    A product listed under several subcategories counts fully in each.
    """
    monthly = (
        with_keys(sales, "product_id", "order_date")
        .groupBy("product_id", "subcategory", month_number(F.col("order_date")).alias("_month"))
        .agg(total("quantity").alias("quantity"))
    )
    early = F.sum(F.when(F.col("_age") <= EARLY_LAST_MONTH, F.col("quantity")))
    # Months become one row per product and subcategory before the product's rows meet again.
    per_product = (
        _since_launch(monthly)
        .groupBy("product_id", "subcategory")
        .agg(early.alias("_early"))
        .withColumn("_early", F.sum("_early").over(Window.partitionBy("product_id")))
    )
    return (
        with_keys(per_product, "subcategory")
        .groupBy("subcategory")
        .agg(mean("_early").alias("average_early_quantity"))
    )


def decline_flags(sales: DataFrame, grain: str = "year_month") -> DataFrame:
    """Has the 3-row rolling mean of a product's quantity fallen strictly over its last periods?

    ``grain``: 'year_month' follows the calendar; 'month_of_year' adds up equal
    months of different years first.
    """
    period = (
        month_number(F.col("order_date")) if grain == "year_month" else F.month("order_date")
    )
    monthly = (
        with_keys(sales, "product_id", "order_date")
        .groupBy("product_id", period.alias("_period"))
        .agg(total("quantity").alias("quantity"))
    )
    rolled = rolling_mean(monthly, ["product_id"], "_period", "quantity", ROLLING_ROWS)
    return is_declining(rolled, ["product_id"], "_period", "rolling", DECLINE_PERIODS)


def lifecycle_summary(sales: DataFrame, grain: str = "year_month") -> DataFrame:
    return launch_success(sales).join(decline_flags(sales, grain), "product_id", "left")


def festival_quantity(sales: DataFrame) -> DataFrame:
    return quantity_by_year(sales.where(F.col("is_festival_sale")))
