"""Customer groups: membership, age, cohorts, lifetime value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.dates import month_label
from orderlens.functions.numeric import mean, ratio, share, total
from orderlens.operators.frames import top_rows, with_keys
from orderlens.operators.histogram import density, histogram
from orderlens.operators.quantiles import box_stats
from orderlens.plans.revenue import revenue_by

MEMBER, NON_MEMBER = "Prime", "Non-Prime"  # fixed values


def member_label(flag: Column) -> Column:
    return F.when(flag, MEMBER).when(~flag, NON_MEMBER)


def _members(sales: DataFrame, *columns: str) -> DataFrame:
    flag = F.col("is_prime_member")
    return sales.where(flag.isNotNull()).select(member_label(flag).alias("member"), *columns)


def member_order_value(sales: DataFrame) -> DataFrame:
    """Mean amount per row for members and others."""
    return _members(sales, "final_amount").groupBy("member").agg(
        mean("final_amount").alias("average_value")
    )


def member_order_frequency(sales: DataFrame) -> DataFrame:
    """Mean number of distinct orders per customer for members and others."""
    per_customer = (
        with_keys(_members(sales, "customer_id", "transaction_id"), "customer_id")
        .groupBy("member", "customer_id")
        .agg(F.count_distinct("transaction_id").alias("orders"))
    )
    return per_customer.groupBy("member").agg(mean("orders").alias("average_orders"))


def member_category_share(sales: DataFrame) -> DataFrame:
    """Categories' part of the revenue of members and of others, in percent."""
    totals = revenue_by(_members(sales, "category", "final_amount"), "member", "category")
    return totals.withColumn("share_percent", share(F.col("revenue"), "member") * 100)


def age_category_share(sales: DataFrame) -> DataFrame:
    """Subcategories' part of each age group's revenue, in percent."""
    totals = revenue_by(sales, "customer_age_group", "subcategory")
    percent = share(F.col("revenue"), "customer_age_group") * 100
    return totals.withColumn("share_percent", percent)


def age_order_value(sales: DataFrame) -> DataFrame:
    """Mean order total per age group: rows are added up per order first."""
    per_order = revenue_by(sales, "customer_age_group", "transaction_id")
    return per_order.groupBy("customer_age_group").agg(mean("revenue").alias("average_value"))


def orders_per_customer_by_age(sales: DataFrame) -> DataFrame:
    return (
        with_keys(sales, "customer_age_group", "customer_id")
        .groupBy("customer_age_group", "customer_id")
        .agg(F.count_distinct("transaction_id").alias("orders"))
    )


def age_order_frequency(sales: DataFrame) -> DataFrame:
    """Box statistics of orders per customer in each age group."""
    return box_stats(orders_per_customer_by_age(sales), "orders", ["customer_age_group"])


def yearly_cohorts(sales: DataFrame) -> DataFrame:
    """Customers of each first-order year still active in its 1st, 2nd, ... year, and their share.

    Rows shrink to one per customer and year before anything looks at a whole
    customer.
    """
    active = with_keys(sales, "customer_id", "order_year").select("customer_id", "order_year")
    active = active.distinct()
    first = F.min("order_year").over(Window.partitionBy("customer_id"))
    counts = (
        active.withColumn("cohort_year", first)
        .withColumn("cohort_index", F.col("order_year") - F.col("cohort_year") + 1)
        .groupBy("cohort_year", "cohort_index")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    start = F.max(F.when(F.col("cohort_index") == 1, F.col("customers"))).over(
        Window.partitionBy("cohort_year")
    )
    return counts.withColumn("retention", ratio(F.col("customers"), start))


def monthly_cohorts(sales: DataFrame) -> DataFrame:
    """Customers per first-order month and order month."""
    active = with_keys(sales, "customer_id", "order_date").select(
        "customer_id", month_label(F.col("order_date")).alias("order_month")
    )
    active = active.distinct()
    first = F.min("order_month").over(Window.partitionBy("customer_id"))
    return (
        active.withColumn("first_month", first)
        .groupBy("first_month", "order_month")
        .agg(F.count(F.lit(1)).alias("customers"))
    )


def lifetime_value(sales: DataFrame) -> DataFrame:
    """Revenue and first year per customer, in one grouping."""
    return (
        with_keys(sales, "customer_id")
        .groupBy("customer_id")
        .agg(total("final_amount").alias("clv"), F.min("order_year").alias("acquisition_year"))
    )


def lifetime_value_by_year(sales: DataFrame) -> DataFrame:
    return box_stats(lifetime_value(sales), "clv", ["acquisition_year"])


def lifetime_value_histogram(sales: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(lifetime_value(sales), "clv", bins)


def lifetime_value_density(sales: DataFrame, points: int = 200) -> DataFrame:
    return density(lifetime_value(sales), "clv", points)


def top_customers(sales: DataFrame, n: int = 10) -> DataFrame:
    """Customers with the highest revenue."""
    totals = revenue_by(sales, "customer_id").withColumnRenamed("revenue", "total_revenue")
    return top_rows(totals, n, "total_revenue", "customer_id")


def order_frequency_histogram(sales: DataFrame, bins: int = 40) -> DataFrame:
    """Histogram of distinct orders per customer."""
    per_customer = (
        with_keys(sales, "customer_id")
        .groupBy("customer_id")
        .agg(F.count_distinct("transaction_id").alias("orders"))
    )
    return histogram(per_customer, "orders", bins)
