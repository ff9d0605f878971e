"""Daily totals kept as a table, from which every date range is answered.

The rollup holds one row per day (and value of further columns): rows, rows with an amount,
revenue and quantity. All are sums, so ranges, periods and groups are sums of its rows. It is
partitioned by month; a refresh recomputes the months of the changed days from ``sales`` (a
date filter that reaches the scan) and overwrites just those partitions, so it can be
repeated after a failure.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.dates import month_label
from orderlens.functions.numeric import ratio, total
from orderlens.operators.frames import between_dates, top_rows
from orderlens.operators.periods import PERIODS, with_empty_periods
from orderlens.operators.settle import release, stage

MEASURES = ("rows", "amounts", "revenue", "quantity")


def daily_totals(sales: DataFrame, by: Sequence[str] = (), date: str = "order_date") -> DataFrame:
    """``order_date, month, *by`` and the measures, one row per day and value of ``by``."""
    days = sales.where(F.col(date).isNotNull())
    return days.groupBy(F.col(date).alias("order_date"), month_label(F.col(date)).alias("month"), *by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("final_amount").alias("amounts"),
        total("final_amount").alias("revenue"),
        total("quantity").alias("quantity"),
    )


def _write(totals: DataFrame, path: str, mode: str) -> None:
    # A month is small: one file each.
    writer = totals.repartition("month").write.mode("overwrite").partitionBy("month")
    writer.option("partitionOverwriteMode", mode).parquet(path)


def write_rollup(sales: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """The whole rollup, replacing what is at ``path``."""
    _write(daily_totals(sales, by), path, "static")


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def refresh_rollup(
    sales: DataFrame, path: str, days: Iterable[datetime.date], by: Sequence[str] = ()
) -> list[str]:
    """Recompute the months of ``days`` from ``sales``; returns the months rewritten.

    A month that has no sales any more loses its rows. Other partitions are not touched.
    """
    months = sorted({day.strftime("%Y-%m") for day in days})
    if not months:
        return []
    changed = F.lit(False)
    for month in months:
        first = datetime.date.fromisoformat(f"{month}-01")
        following = (first + datetime.timedelta(days=32)).replace(day=1)
        changed |= (F.col("order_date") >= F.lit(first)) & (F.col("order_date") < F.lit(following))
    totals = stage(daily_totals(sales.where(changed), by))
    _write(totals, path, "dynamic")
    spark = sales.sparkSession
    empty = set(months) - {r.month for r in totals.select("month").distinct().collect()}
    for month in empty:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/month={month}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    release(totals)
    return months


def _days(rollup: DataFrame, start, end) -> DataFrame:
    """The rows of a range of days; months outside it are not listed or read."""
    if start is None:
        return rollup
    first, last = (F.date_format(F.lit(str(day)).cast("date"), "yyyy-MM") for day in (start, end))
    return between_dates(rollup, start, end).where(F.col("month").between(first, last))


def range_kpis(rollup: DataFrame, start=None, end=None, value_over: str = "rows") -> DataFrame:
    """As ``dashboard.kpis``: rows, revenue and mean order value of a date range."""
    chosen = _days(rollup, start, end)
    over = {"rows": total("rows"), "amounts": total("amounts")}[value_over]
    summed = chosen.agg(total("rows").alias("orders"), total("revenue").alias("revenue"), over.alias("_over"))
    value = F.coalesce(ratio(F.col("revenue"), F.col("_over")), F.lit(0.0))
    return summed.withColumn("average_order_value", value).drop("_over")


def range_trend(rollup: DataFrame, period: str = "M", start=None, end=None) -> DataFrame:
    """As ``dashboard.trend`` over a date range: revenue and orders per period, empty ones included."""
    chosen = _days(rollup, start, end)
    unit, _ = PERIODS[period]
    totals = chosen.groupBy(F.trunc("order_date", unit).alias("_start")).agg(
        total("revenue").alias("revenue"), total("rows").alias("orders")
    )
    return with_empty_periods(totals, period)


def month_totals(rollup: DataFrame) -> DataFrame:
    """As ``revenue.month_summary``: revenue per calendar month in the data."""
    return rollup.groupBy(F.col("month").alias("period_month")).agg(total("revenue").alias("revenue"))


def range_top(rollup: DataFrame, column: str, n: int, start=None, end=None) -> DataFrame:
    """The ``n`` values of a rollup column with the highest revenue in a date range."""
    chosen = _days(rollup, start, end)
    summed = chosen.where(F.col(column).isNotNull()).groupBy(column).agg(total("revenue").alias("revenue"))
    return top_rows(summed, n, "revenue", column)
