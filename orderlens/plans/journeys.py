"""How customers move between purchases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import share
from orderlens.operators.frames import matrix_cells
from orderlens.operators.histogram import density, histogram
from orderlens.operators.sequences import day_gaps, first_and_last, transitions

# Fixed values
LOYAL_ROWS = 5
LOYAL, NEW = "Loyal", "New"
# Rows of a customer in order; the last column must tell rows of one order apart.
ROW_ORDER = ("order_date", "transaction_id", "product_id")


def days_between_orders(sales: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram of the days between consecutive rows of a customer."""
    gaps = day_gaps(sales, "customer_id", "order_date")
    return histogram(gaps, "days", bins, weight=F.col("n"))


def days_between_orders_density(sales: DataFrame, points: int = 200) -> DataFrame:
    gaps = day_gaps(sales, "customer_id", "order_date")
    return density(gaps, "days", points, weight=F.col("n"))


def category_transitions(sales: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Counts of subcategory changes between consecutive rows and their row-wise probability."""
    within_day = [name for name in order if name != "order_date"]
    counts = transitions(sales, "customer_id", "order_date", within_day, "subcategory")
    return counts.withColumn("probability", share(F.col("count"), "previous"))


def transition_matrix(sales: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Probabilities of all pairs of subcategories, 0 where a change never happens."""
    long = category_transitions(sales, order)
    return matrix_cells(long, "previous", "following", "probability", 0.0)


def customer_journeys(sales: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Customers by loyalty, first and last subcategory."""
    per_customer = first_and_last(sales, "customer_id", order, "subcategory")
    status = F.when(F.col("rows") >= LOYAL_ROWS, LOYAL).otherwise(NEW)
    return (
        per_customer.where(F.col("first_subcategory").isNotNull())
        .groupBy(
            status.alias("customer_status"),
            F.col("first_subcategory").alias("first_category"),
            F.col("last_subcategory").alias("last_category"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )


def journey_matrix(sales: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Customers per pair of first and last subcategory, 0 where there are none."""
    journeys = customer_journeys(sales, order)
    counts = journeys.groupBy("first_category", "last_category").agg(F.sum("count").alias("count"))
    return matrix_cells(counts, "first_category", "last_category", "count", 0)


def first_category_counts(sales: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    journeys = customer_journeys(sales, order)
    return journeys.groupBy("customer_status", "first_category").agg(F.sum("count").alias("count"))
