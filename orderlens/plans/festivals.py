"""Sales around festival days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import mean, total
from orderlens.operators.frames import with_keys

WINDOW_DAYS = 7  # fixed value


def festival_lift(sales: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Mean revenue of all sales on each day from ``-days`` to ``+days`` of a festival's dates.

    Sales shrink to one row per calendar day and festival dates unfold to the
    days around them, so the range condition becomes an equality join of two
    small tables. Days without sales do not count as 0.
    """
    daily = with_keys(sales, "order_date").groupBy("order_date").agg(
        total("final_amount").alias("revenue")
    )
    around = (
        with_keys(sales.where(F.col("is_festival_sale")), "festival_name", "order_date")
        .select("festival_name", F.col("order_date").alias("_day"))
        .distinct()
        .withColumn("relative_day", F.explode(F.sequence(F.lit(-days), F.lit(days))))
        .withColumn("order_date", F.date_add("_day", F.col("relative_day")))
    )
    return (
        around.join(daily, "order_date")
        .groupBy("festival_name", "relative_day")
        .agg(mean("revenue").alias("average_revenue"), F.count(F.lit(1)).alias("occurrences"))
    )
