"""Yearly business health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import mean, rate
from orderlens.operators.frames import with_keys
from orderlens.operators.sequences import day_visits
from orderlens.plans.operations import returned
from orderlens.plans.revenue import revenue_by

RETENTION_DAYS = 60  # fixed value


def customer_health(sales: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """Per year: revenue, customers, new customers and retained customers.

    A customer is retained in a year when some row of that year is followed by
    another one within ``days``. A customer is new in the year of the earliest
    row. Both follow from one row per customer and day.
    """
    visits = day_visits(sales, "customer_id", "order_date")
    followed = (F.col("rows") > 1) | (F.datediff("next_date", "order_date") <= days)
    per_year = visits.groupBy("customer_id", F.year("order_date").alias("order_year")).agg(
        F.max(F.coalesce(followed, F.lit(False))).alias("_retained"),
        F.max(F.col("previous_date").isNull()).alias("_new"),
    )
    customers = per_year.groupBy("order_year").agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if("_new").alias("new_customers"),
        F.count_if("_retained").alias("retained_customers"),
    )
    return revenue_by(sales, "order_year").join(customers, "order_year", "left").fillna(0)


def operations_health(sales: DataFrame) -> DataFrame:
    """Per year: mean delivery days and return rate."""
    return (
        with_keys(sales, "order_year")
        .groupBy("order_year")
        .agg(
            mean("delivery_days").alias("average_delivery_days"),
            rate(returned()).alias("return_rate"),
        )
    )
