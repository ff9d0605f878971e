"""Revenue by category and subcategory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.numeric import percent_change, ratio
from orderlens.functions.text import label_missing
from orderlens.operators.frames import complete_grid, observed_values, top_rows
from orderlens.operators.settle import settle
from orderlens.plans.revenue import revenue_by

UNKNOWN, OTHERS, ALL = "Unknown", "Others", "All"  # fixed values


def _labelled(sales: DataFrame, *more: str) -> DataFrame:
    return sales.select(
        label_missing(F.col("category"), UNKNOWN).alias("main_category"),
        label_missing(F.col("subcategory"), UNKNOWN).alias("category"),
        "final_amount",
        *more,
    )


def category_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per subcategory; a missing one counts as 'Unknown'."""
    labelled = sales.select(
        label_missing(F.col("subcategory"), UNKNOWN).alias("category"), "final_amount"
    )
    return revenue_by(labelled, "category")


def category_share(sales: DataFrame, top: int = 6) -> DataFrame:
    """The largest subcategories and 'Others' with their part of all revenue in percent."""
    totals = category_revenue(sales)
    best = top_rows(totals, top, "revenue", "category")
    # Others is what is left of the total: no second look at the small ones.
    everything = totals.agg(F.sum("revenue").alias("r")).scalar()
    others = (
        best.agg(F.sum("revenue").alias("_top"))
        .withColumn("_all", everything)
        .select(
            F.lit(OTHERS).alias("category"),
            F.coalesce(F.col("_all") - F.col("_top"), F.lit(0)).alias("revenue"),
        )
    )
    pie = best.unionByName(others).withColumn("_all", everything)
    percent = ratio(F.col("revenue"), F.col("_all")) * 100
    return pie.withColumn("share_percent", percent).drop("_all")


def category_tree(sales: DataFrame) -> DataFrame:
    """Totals of each subcategory, each category and everything; level 2, 1 and 0."""
    leaves = revenue_by(_labelled(sales), "main_category", "category")
    # Leaves are grouped first, so the rollup triples only the leaves.
    rolled = leaves.rollup("main_category", "category").agg(
        F.sum("revenue").alias("revenue"),
        (2 - F.grouping("main_category") - F.grouping("category")).cast("int").alias("level"),
    )
    return rolled.select(
        label_missing(F.col("main_category"), ALL).alias("main_category"),
        label_missing(F.col("category"), ALL).alias("category"),
        "level",
        "revenue",
    )


def category_growth(sales: DataFrame) -> DataFrame:
    """Revenue per subcategory and year (0 where none) and growth in percent.

    Growth from 0 is undefined and stays missing; the year is kept.
    """
    labelled = sales.select(
        label_missing(F.col("subcategory"), UNKNOWN).alias("category"),
        "order_year",
        "final_amount",
    )
    # A row per category and year, needed three times: for the years, the spine and the values.
    totals = settle(revenue_by(labelled, "category", "order_year"))
    years = observed_values(totals, "order_year")
    grid = complete_grid(totals, "category", "order_year", years, {"revenue": 0})
    order = Window.partitionBy("category").orderBy("order_year")
    return grid.withColumn("growth_percent", percent_change(F.col("revenue"), order))
