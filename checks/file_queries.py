"""Reading and writing: the given tables go out to the shared folder and come back."""

from __future__ import annotations

import datetime
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.dashboard_queries import KPI, resample_sql
from checks.registry import REV, I, add
from checks.report_queries import CLV, LIFETIME
from orderlens.operators.settle import shared_folder
from orderlens.plans import cleaning, customers, rollup
from orderlens.sources import files


def fresh_folder(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"


def yearly_csv_union(sales: DataFrame) -> DataFrame:
    """CSV files named by year, odd years with a column more, read as one folder and summed."""
    folder = fresh_folder(sales)
    # File names of this century: the years of the tables, moved by twenty.
    named = F.col("order_year") + 20
    text = sales.select("order_year", "transaction_id", F.col("quantity").cast("string"), "brand", named.alias("named"))
    for rest, part in ((0, text.drop("brand")), (1, text)):
        files.write_yearly_csv(part.where(F.col("order_year") % 2 == rest), folder, "named")
    read = files.read_yearly_csv(sales.sparkSession, folder)
    return read.groupBy(F.col("order_year").cast("int").alias("order_year")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("quantity").cast("int")).alias("quantity"),
        F.count("brand").alias("branded"),
    )


def catalogue_round_trip(sales: DataFrame) -> DataFrame:
    """The product list as a CSV file with text flags, read and cleaned."""
    folder = fresh_folder(sales)
    flag = F.when(F.col("product_id") % 3 == 0, "Yes").when(F.col("product_id") % 3 == 1, "no")
    listed = sales.select("product_id", "brand", flag.alias("is_prime_eligible")).distinct()
    path = files.write_report(listed, folder, "catalogue")
    cleaned = cleaning.clean_catalogue(files.read_catalogue(sales.sparkSession, path))
    return cleaned.groupBy("brand").agg(
        F.count("product_id").alias("products"), F.sum("is_prime_eligible").alias("prime"),
        F.count_if(F.col("is_prime_eligible").isNull()).alias("unknown"),
    )


def table_listing(sales: DataFrame) -> DataFrame:
    """Two saved tables: listed, counted, and the rows of a preview."""
    spark, mark = sales.sparkSession, uuid.uuid4().hex
    names = {f"orders_{mark}": "orders", f"brands_{mark}": "brands"}
    files.save_table(sales.select("transaction_id", "customer_id"), f"orders_{mark}")
    files.save_table(sales.select("brand").distinct(), f"brands_{mark}")
    listed = [name for name in files.list_tables(spark) if name in names]
    counts = files.table_counts(spark, listed)
    shown = [
        files.preview(spark.table(n)).agg(F.count(F.lit(1)).alias("shown")).select(F.lit(n).alias("table"), "shown")
        for n in listed
    ]
    label = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("table"))
    return counts.join(reduce(DataFrame.unionAll, shown), "table").select(label.alias("table"), "rows", "shown")


def rolled_up(sales: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The rollup of all days but one, with that day added by a refresh."""
    path = fresh_folder(sales)
    late = datetime.date(1996, 7, 15)
    rollup.write_rollup(sales.where(F.col("order_date") != F.lit(late)), path, by)
    rollup.refresh_rollup(sales, path, [late], by)
    return rollup.read_rollup(sales.sparkSession, path)


def lifetime_from_buckets(sales: DataFrame) -> DataFrame:
    """Lifetime values from a table bucketed by customer: grouped without a shuffle."""
    name = f"sales_{uuid.uuid4().hex}"
    files.save_bucketed(sales, name, buckets=8)
    return customers.lifetime_value(sales.sparkSession.table(name))


def sales_by_year_parquet(sales: DataFrame) -> DataFrame:
    """Written by year and read back, all years."""
    folder = fresh_folder(sales)
    files.write_sales(sales, folder)
    read = files.read_sales(sales.sparkSession, folder)
    return read.groupBy("order_year", "customer_tier").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("final_amount").alias("revenue")
    )


def report_csv(sales: DataFrame) -> DataFrame:
    folder = fresh_folder(sales)
    table = sales.groupBy("brand").agg(F.sum("quantity").alias("quantity"))
    path = files.write_report(table, folder, "brands")
    read = files.read_csv(sales.sparkSession, path)
    return read.select("brand", F.col("quantity").cast("bigint").alias("quantity"))


def table_replaced(sales: DataFrame) -> DataFrame:
    """Saved twice under one name: the second replaces the first."""
    name = f"transactions_{uuid.uuid4().hex}"
    files.save_table(sales.select("order_year"), name)
    files.save_table(sales.select("order_year", "quantity"), name)
    return sales.sparkSession.table(name).groupBy("order_year").agg(
        F.sum("quantity").alias("quantity")
    )


def exported_csv(sales: DataFrame) -> DataFrame:
    folder = fresh_folder(sales)
    files.export_csv(sales, folder, ("transaction_id", "customer_id", "missing_column"))
    read = files.read_csv(sales.sparkSession, folder)
    return read.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("customers")
    )


add("yearly_csv_union", "order_year transaction_id quantity brand", yearly_csv_union, f"""
SELECT {I('order_year')} AS order_year, count(*) AS "rows", {I('sum(quantity)')} AS quantity,
  count(brand) FILTER (order_year % 2 = 1) AS branded FROM sales GROUP BY 1""")  # fmt: skip
add("catalogue_round_trip", "product_id brand", catalogue_round_trip, f"""
SELECT brand, count(*) AS products, {I('sum(CASE product_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END)')} AS prime,
  count(*) FILTER (product_id % 3 = 2) AS unknown
FROM (SELECT DISTINCT product_id, brand FROM sales) GROUP BY brand""")  # fmt: skip
add("table_listing", "transaction_id customer_id brand", table_listing, """
WITH t AS (SELECT 'orders' AS "table", count(*) AS "rows" FROM sales
  UNION ALL SELECT 'brands', count(DISTINCT brand) FROM sales)
SELECT "table", "rows", least("rows", 200) AS shown FROM t""")
DAILY = "order_date final_amount quantity"
add("rollup_kpis_date_range", DAILY,
    lambda sales: rollup.range_kpis(rolled_up(sales), "1996-02-10", "1998-11-30"),
    KPI + " WHERE order_date BETWEEN DATE '1996-02-10' AND DATE '1998-11-30'")
add("rollup_kpis_empty_range", DAILY,
    lambda sales: rollup.range_kpis(rolled_up(sales), "2031-01-01", "2031-12-31", "amounts"),
    KPI + " WHERE order_date BETWEEN DATE '2031-01-01' AND DATE '2031-12-31'")
add("rollup_trend_by_quarter", DAILY, lambda sales: rollup.range_trend(rolled_up(sales), "Q"),
    resample_sql("quarter", "sales"))
add("rollup_month_totals", DAILY, lambda sales: rollup.month_totals(rolled_up(sales)), f"""
SELECT strftime(order_date, '%Y-%m') AS period_month, {REV} FROM sales GROUP BY 1""")  # fmt: skip
add("rollup_top_products", f"{DAILY} product_title",
    lambda sales: rollup.range_top(rolled_up(sales, ("product_title",)), "product_title", 10, "1996-01-01", "1996-12-31"), f"""
SELECT product_title, {REV} FROM sales WHERE order_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'
GROUP BY 1 ORDER BY sum(final_amount) DESC, product_title LIMIT 10""")  # fmt: skip
add("lifetime_from_buckets", LIFETIME, lifetime_from_buckets, f"""
SELECT {I('customer_id')} AS customer_id, CAST(clv AS DOUBLE) AS clv,
  {I('acquisition_year')} AS acquisition_year FROM {CLV}""")  # fmt: skip
add("sales_by_year_parquet", "order_year customer_tier final_amount", sales_by_year_parquet, f"""
SELECT {I('order_year')} AS order_year, customer_tier, count(*) AS "rows", {REV} FROM sales
GROUP BY 1, 2""")  # fmt: skip
add("report_csv", "brand quantity", report_csv,
    f"SELECT brand, {I('sum(quantity)')} AS quantity FROM sales GROUP BY 1")
add("table_replaced", "order_year quantity", table_replaced,
    f"SELECT {I('order_year')} AS order_year, {I('sum(quantity)')} AS quantity FROM sales GROUP BY 1")
add("exported_csv", "transaction_id customer_id", exported_csv, """
SELECT count(*) AS "rows", count(DISTINCT customer_id) AS customers FROM sales""")
