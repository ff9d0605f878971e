"""Cleaning rules on dirty text derived from the given tables.

The text is spelled from clean columns inside the query, so the SQL can state
the expected result from those columns without repeating any parsing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import I, R, add
from orderlens.functions import bins, dates, delivery, payment, text
from orderlens.operators import duplicates, outliers
from orderlens.operators.settle import shared_folder, stage
from orderlens.plans import cleaning


def product():
    return F.col("product_id")


def _pick(code, *options):
    """Option number ``code`` of the given texts."""
    chain = options[-1]
    for i, option in reversed(list(enumerate(options[:-1]))):
        chain = F.when(code == i, option).otherwise(chain)
    return chain


def date_text():
    return _pick(
        product() % 4,
        F.date_format("order_date", "yyyy-MM-dd"),
        F.date_format("order_date", "dd/MM/yyyy"),
        F.date_format("order_date", "dd-MM-yyyy"),
        F.lit("n/a"),
    )


add("clean_dates", "product_id order_date", lambda sales: sales.select(
    "product_id", dates.parse_date(date_text()).alias("order_date")
).groupBy("order_date").agg(F.count(F.lit(1)).alias("rows")), """
SELECT CASE WHEN product_id % 4 <> 3 THEN order_date END AS order_date, count(*) AS "rows"
FROM sales GROUP BY 1""")  # fmt: skip


def price_text():
    return _pick(
        product() % 4,
        F.concat(F.lit("₹"), F.format_number("original_price", 2)),
        F.concat(F.lit("Rs "), F.col("original_price").cast("string")),
        F.col("original_price").cast("string"),
        F.lit("Price on Request"),
    )


add("clean_prices", "product_id subcategory original_price", lambda sales: sales.withColumn(
    "price", text.clean_price(price_text())
).groupBy("subcategory").agg(
    F.count("price").alias("priced"), F.count(F.lit(1)).alias("rows"),
    F.sum("price").alias("total")), """
SELECT subcategory, count(*) FILTER (product_id % 4 <> 3) AS priced, count(*) AS "rows",
  CAST(sum(original_price) FILTER (product_id % 4 <> 3) AS DOUBLE) AS total
FROM sales GROUP BY 1""")  # fmt: skip
add("clean_plain_prices", "product_id subcategory original_price", lambda sales: sales.withColumn(
    "price", text.plain_price(price_text())
).groupBy("subcategory").agg(
    F.count("price").alias("priced"), F.round(F.max("price"), 2).alias("highest")), f"""
SELECT subcategory, count(*) FILTER (product_id % 4 IN (0, 2)) AS priced,
  {R('max(original_price) FILTER (product_id % 4 IN (0, 2))')} AS highest
FROM sales GROUP BY 1""")  # fmt: skip


def rating():
    return F.col("product_rating").cast("int").cast("string")


add("clean_ratings", "product_id product_rating", lambda sales: sales.select(
    text.clean_rating(_pick(
        product() % 4, F.concat(rating(), F.lit(".5/5")), F.concat(rating(), F.lit(" stars")), rating(),
        F.lit("good"))).alias("rating")
).groupBy("rating").agg(F.count(F.lit(1)).alias("rows")), f"""
SELECT {R('''CASE product_id % 4 WHEN 0 THEN product_rating + 0.5 WHEN 3 THEN NULL
  ELSE product_rating END''')} AS rating, count(*) AS "rows" FROM sales GROUP BY 1""")  # fmt: skip

# The given cities carry invented names; five of them take misspelled real ones.
def city_text():
    spellings = ("  Bombay ", "banglore", "CALCUTTA", "chenai", "delhi ncr", "delhi-x", "pune")
    return _pick(product() % 8, *map(F.lit, spellings), F.lower("customer_city"))


add("clean_cities", "product_id customer_city", lambda sales: sales.select(
    text.clean_city(city_text()).alias("city")).groupBy("city").agg(F.count(F.lit(1)).alias("rows")), """
SELECT CASE product_id % 8 WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Bengaluru' WHEN 2 THEN 'Kolkata'
  WHEN 3 THEN 'Chennai' WHEN 4 THEN 'Delhi' WHEN 5 THEN 'Delhi-X' WHEN 6 THEN 'Pune'
  ELSE 'Nation' || substr(customer_city, 7) END AS city, count(*) AS "rows"
FROM sales GROUP BY 1""")  # fmt: skip


def category_text():
    spellings = ("ELECTRONICSS", " electronic", "electronics & accessories", "home decor")
    return _pick(product() % 5, *map(F.lit, spellings), F.lower("category"))


add("clean_categories", "product_id category", lambda sales: sales.select(
    text.clean_category(category_text()).alias("category")
).groupBy("category").agg(F.count(F.lit(1)).alias("rows")), """
SELECT CASE product_id % 5 WHEN 0 THEN 'Electronics' WHEN 1 THEN 'Electronics'
  WHEN 2 THEN 'Electronics & Accessories' WHEN 3 THEN 'Home Decor'
  ELSE upper(substr(category, 1, 1)) || lower(substr(category, 2)) END AS category,
  count(*) AS "rows" FROM sales GROUP BY 1""")  # fmt: skip
add("clean_flags", "product_id is_prime_member", lambda sales: sales.select(
    text.clean_flag(_pick(
        product() % 4,
        F.when(F.col("is_prime_member"), "Yes").otherwise("n"),
        F.when(F.col("is_prime_member"), "1").otherwise("0"),
        F.when(F.col("is_prime_member"), " TRUE").otherwise("False"),
        F.lit("maybe"))).alias("member")
).groupBy("member").agg(F.count(F.lit(1)).alias("rows")), """
SELECT CASE WHEN product_id % 4 <> 3 THEN is_prime_member END AS member, count(*) AS "rows"
FROM sales GROUP BY 1""")  # fmt: skip


def days():
    return F.col("delivery_days").cast("string")


add("clean_delivery_whole", "product_id delivery_days", lambda sales: sales.select(
    delivery.whole_days(_pick(
        product() % 6, F.concat(days(), F.lit(" days")),
        F.concat(days(), F.lit("-"), (F.col("delivery_days") + 1).cast("string"), F.lit(" days")),
        F.lit("Same Day"), F.lit("express"), F.concat(F.lit("4"), days()),
        F.lit("soon"))).alias("days")
).groupBy("days").agg(F.count(F.lit(1)).alias("rows")), f"""
SELECT {R('''CASE product_id % 6 WHEN 0 THEN delivery_days
  WHEN 1 THEN CASE WHEN delivery_days % 2 = 0 THEN delivery_days ELSE delivery_days + 1 END
  WHEN 2 THEN 0 WHEN 3 THEN 0 END''')} AS days, count(*) AS "rows" FROM sales GROUP BY 1""")  # fmt: skip
add("clean_delivery_average", "product_id delivery_days", lambda sales: sales.select(
    delivery.average_days(_pick(
        product() % 6, F.concat(days(), F.lit(" days")),
        F.concat(days(), F.lit("-"), (F.col("delivery_days") + 1).cast("string"), F.lit(" days")),
        F.lit("same day delivery"), F.lit("Express"), F.concat(F.lit("-"), days()),
        F.lit("soon"))).alias("days")
).groupBy("days").agg(F.count(F.lit(1)).alias("rows")), f"""
SELECT {R('''CASE product_id % 6 WHEN 0 THEN delivery_days WHEN 1 THEN delivery_days + 0.5
  WHEN 2 THEN 0 WHEN 3 THEN 0.5 END''')} AS days, count(*) AS "rows" FROM sales GROUP BY 1""")  # fmt: skip


def payment_text():
    method, even = F.col("payment_method"), product() % 2 == 0
    return (
        F.when(product() % 7 == 6, F.lit("Cheque"))
        .when((method == "UPI") & even, "PhonePe")
        .when((method == "COD") & even, "C.O.D")
        .when((method == "Credit Card") & even, "CC")
        .when((method == "Debit Card") & even, "DEBIT_CARD")
        .when((method == "Net Banking") & even, "NetBanking")
        .otherwise(method)
    )


add("clean_payments", "product_id payment_method", lambda sales: sales.select(
    payment.standard_method(payment_text()).alias("method")
).groupBy("method").agg(F.count(F.lit(1)).alias("rows")), """
SELECT CASE WHEN product_id % 7 <> 6 THEN payment_method END AS method, count(*) AS "rows"
FROM sales GROUP BY 1""")  # fmt: skip
add("price_bins", "original_price quantity", lambda sales: sales.select(
    bins.price_bin(F.col("original_price"), F.lit(100000)).alias("price_bin"), "quantity"
).groupBy("price_bin").agg(F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity")), f"""
SELECT CASE WHEN original_price < 500 THEN '0-500' WHEN original_price < 1000 THEN '500-1000'
  WHEN original_price < 2000 THEN '1000-2000' WHEN original_price < 5000 THEN '2000-5000'
  WHEN original_price < 10000 THEN '5000-10000' WHEN original_price < 100000 THEN '10000+' END
  AS price_bin, count(*) AS "rows", {I('sum(quantity)')} AS quantity FROM sales GROUP BY 1""")  # fmt: skip

# ---- Duplicates ------------------------------------------------------------------------------------
# No two rows agree on all six keys, so part of the rows is added once more under a new id.
DUPLICATE_COLUMNS = (
    "transaction_id order_date customer_id product_id original_price discounted_price "
    "final_amount quantity l_linenumber l_suppkey"
)


def with_copies(sales: DataFrame) -> DataFrame:
    """Every row, and some of them twice, in one read."""
    sales = sales.withColumn("row_id", F.concat_ws("-", "transaction_id", "l_linenumber", "l_suppkey"))
    copies = F.when(product() % 50 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    copied = F.col("_copy")
    return sales.withColumn("_copy", F.explode(copies)).withColumns({
        "quantity": F.when(copied & (product() % 100 == 0), F.col("quantity") + 1).otherwise(F.col("quantity")),
        "row_id": F.when(copied, F.concat("row_id", F.lit("-dup"))).otherwise(F.col("row_id")),
    }).drop("_copy")


def kept_copies(sales: DataFrame) -> DataFrame:
    """``with_copies`` computed once: the operators read their rows several times."""
    return stage(with_copies(sales).select(*duplicates.DUPLICATE_KEYS, "quantity", "row_id"))


COPIES = """s AS (SELECT *, transaction_id || '-' || l_linenumber || '-' || l_suppkey AS row_id
    FROM sales),
  u AS (SELECT row_id, order_date, customer_id, product_id, original_price, discounted_price,
          final_amount, quantity FROM s UNION ALL
        SELECT row_id || '-dup', order_date, customer_id, product_id, original_price,
          discounted_price, final_amount,
          CASE WHEN product_id % 100 = 0 THEN quantity + 1 ELSE quantity END
        FROM s WHERE product_id % 50 = 0),
  k AS (SELECT *, count(*) OVER g AS n, CAST(sum(quantity) OVER g AS DOUBLE) AS q,
          CAST(sum(final_amount) OVER g AS DOUBLE) AS a,
          first_value(quantity) OVER f AS q1, first_value(CAST(final_amount AS DOUBLE)) OVER f AS a1
        FROM u WINDOW g AS (PARTITION BY order_date, customer_id, product_id, original_price,
            discounted_price, final_amount),
          f AS (PARTITION BY order_date, customer_id, product_id, original_price,
            discounted_price, final_amount ORDER BY row_id)),
  t AS (SELECT *, n > 1 AS is_duplicate, CASE WHEN n = 1 OR discounted_price IS NULL THEN 'normal'
          WHEN q1 <> 0 AND abs(q * (a1 / q1) - a) < 0.01 THEN 'bulk_order'
          ELSE 'error_duplicate' END AS duplicate_type FROM k)"""
add("duplicate_classes", DUPLICATE_COLUMNS,
    lambda sales: duplicates.classify_duplicates(kept_copies(sales), row_id="row_id").select(
        "row_id", "quantity", "is_duplicate", "duplicate_type"), f"""
WITH {COPIES} SELECT row_id, {I('quantity')} AS quantity, is_duplicate, duplicate_type
FROM t""")  # fmt: skip
add("duplicate_class_counts", DUPLICATE_COLUMNS,
    lambda sales: duplicates.classify_duplicates(kept_copies(sales), row_id="row_id").groupBy(
        "duplicate_type").agg(F.count(F.lit(1)).alias("rows"),
        F.count_if("is_duplicate").alias("duplicates")), f"""
WITH {COPIES} SELECT duplicate_type, count(*) AS "rows",
  count(*) FILTER (is_duplicate) AS duplicates FROM t GROUP BY 1""")  # fmt: skip
def grown_summary(sales: DataFrame) -> DataFrame:
    """Groups per class, from a kept summary of the early years to which the others are added."""
    rows, path = kept_copies(sales), f"{shared_folder(sales.sparkSession)}/summary-{uuid.uuid4().hex}"
    early = F.col("order_date") < F.lit("1996-07-10").cast("date")
    duplicates.write_summary(rows.where(early), path, row_id="row_id")
    duplicates.add_to_summary(rows.where(~early), path, row_id="row_id")
    groups = duplicates.judged(duplicates.read_summary(sales.sparkSession, path))
    return groups.groupBy("duplicate_type").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("copies").alias("rows"), F.sum("total_quantity").alias("quantity")
    )


add("duplicate_groups_grown", DUPLICATE_COLUMNS, grown_summary, f"""
WITH {COPIES}, g AS (SELECT duplicate_type, count(*) AS n, sum(quantity) AS q FROM t WHERE is_duplicate
  GROUP BY duplicate_type, order_date, customer_id, product_id, original_price, discounted_price, final_amount)
SELECT duplicate_type, count(*) AS "groups", {I('sum(n)')} AS "rows", {I('sum(q)')} AS quantity FROM g
GROUP BY 1""")  # fmt: skip
add("consolidated_bulk_orders", DUPLICATE_COLUMNS,
    lambda sales: duplicates.consolidate_bulk_orders(kept_copies(sales), row_id="row_id"), f"""
WITH {COPIES} SELECT order_date, {I('customer_id')} AS customer_id,
  {I('product_id')} AS product_id, CAST(original_price AS DOUBLE) AS original_price,
  CAST(discounted_price AS DOUBLE) AS discounted_price,
  CAST(final_amount AS DOUBLE) AS final_amount, {I('sum(quantity)')} AS total_quantity,
  CAST(sum(t.final_amount) AS DOUBLE) AS total_amount,
  string_agg(row_id, ',' ORDER BY row_id) AS transaction_ids
FROM t WHERE duplicate_type = 'bulk_order' GROUP BY t.order_date, t.customer_id, t.product_id,
  t.original_price, t.discounted_price, t.final_amount""")  # fmt: skip

add("bulk_order_totals", DUPLICATE_COLUMNS,
    lambda sales: duplicates.bulk_order_totals(
        kept_copies(sales).withColumn("subtotal", F.col("original_price") * F.col("quantity")),
        row_id="row_id", totals=["subtotal"]), f"""
WITH {COPIES} SELECT order_date, {I('customer_id')} AS customer_id,
  {I('product_id')} AS product_id, CAST(original_price AS DOUBLE) AS original_price,
  CAST(discounted_price AS DOUBLE) AS discounted_price,
  CAST(final_amount AS DOUBLE) AS final_amount, count(*) AS copies,
  {I('sum(quantity)')} AS total_quantity, CAST(sum(t.final_amount) AS DOUBLE) AS total_amount,
  CAST(sum(t.original_price * quantity) AS DOUBLE) AS total_subtotal
FROM t WHERE duplicate_type = 'bulk_order' GROUP BY t.order_date, t.customer_id, t.product_id,
  t.original_price, t.discounted_price, t.final_amount""")  # fmt: skip
add("bulk_order_members", DUPLICATE_COLUMNS,
    lambda sales: duplicates.bulk_order_members(kept_copies(sales), row_id="row_id"), f"""
WITH {COPIES} SELECT order_date, {I('customer_id')} AS customer_id,
  {I('product_id')} AS product_id, CAST(original_price AS DOUBLE) AS original_price,
  CAST(discounted_price AS DOUBLE) AS discounted_price,
  CAST(final_amount AS DOUBLE) AS final_amount, row_id
FROM t WHERE duplicate_type = 'bulk_order'""")  # fmt: skip

# ---- Outliers ----------------------------------------------------------------------------------------
OUTLIER_COLUMNS = "transaction_id l_linenumber subcategory brand original_price"
PRICE = "CAST(original_price AS DOUBLE)"
# Prices are raised for some rows so that both rules have something to find.
RAISED = f"CASE WHEN l_linenumber = 7 THEN {PRICE} * 10 ELSE {PRICE} END"


def raised(sales: DataFrame) -> DataFrame:
    price = F.col("original_price").cast("double")
    return sales.withColumn(
        "original_price", F.when(F.col("l_linenumber") == 7, price * 10).otherwise(price)
    )


FENCES = f"""x AS (SELECT transaction_id, l_linenumber, subcategory, brand, {RAISED} AS p
    FROM sales),
  q AS (SELECT subcategory, brand, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3,
          avg(p) AS m, stddev_samp(p) AS s FROM x GROUP BY 1, 2),
  f AS (SELECT x.*, p < q1 - 1.5 * (q3 - q1) OR p > q3 + 1.5 * (q3 - q1) AS iqr,
          coalesce(s > 0 AND (p < m - 3 * s OR p > m + 3 * s), FALSE) AS sigma
        FROM x JOIN q USING (subcategory, brand))"""
CELLS = f"transaction_id, {I('l_linenumber')} AS l_linenumber, subcategory, brand"
KEPT = ["transaction_id", "l_linenumber", "subcategory", "brand"]
add("price_outliers_iqr", OUTLIER_COLUMNS,
    lambda sales: outliers.flag_iqr_outliers(raised(sales)).select(*KEPT, "price_outlier_iqr"), f"""
WITH {FENCES} SELECT {CELLS}, iqr AS price_outlier_iqr FROM f""")  # fmt: skip
add("price_outliers_sigma", OUTLIER_COLUMNS,
    lambda sales: outliers.flag_sigma_outliers(raised(sales)).select(
        *KEPT, "price_outlier_3_sigma"), f"""
WITH {FENCES} SELECT {CELLS}, sigma AS price_outlier_3_sigma FROM f""")  # fmt: skip
add("price_outlier_counts", OUTLIER_COLUMNS,
    lambda sales: outliers.flag_price_outliers(raised(sales)).groupBy("subcategory", "brand").agg(
        F.count_if("price_outlier_iqr").alias("iqr_outliers"),
        F.count_if("price_outlier_3_sigma").alias("sigma_outliers")), f"""
WITH {FENCES} SELECT subcategory, brand, count(*) FILTER (iqr) AS iqr_outliers,
  count(*) FILTER (sigma) AS sigma_outliers FROM f GROUP BY 1, 2""")  # fmt: skip

# ---- The whole cleaning job -------------------------------------------------------------------------------
RAW_SOURCE = (
    "transaction_id order_date customer_id product_id category subcategory brand original_price "
    "discounted_price quantity final_amount customer_city customer_state customer_tier "
    "customer_age_group is_prime_member is_festival_sale festival_name payment_method "
    "delivery_days customer_rating product_rating return_status l_linenumber l_suppkey"
)


def raw_text(sales: DataFrame) -> DataFrame:
    """Order lines as a raw file would hold them: everything is text, spelled in several ways."""
    as_text = lambda name: F.col(name).cast("string").alias(name)
    text = sales.select(
        "row_id" if "row_id" in sales.columns
        else F.concat_ws("-", "transaction_id", "l_linenumber", "l_suppkey").alias("row_id"),
        date_text().alias("order_date"),
        as_text("customer_id"),
        as_text("product_id"),
        category_text().alias("category"),
        "subcategory",
        "brand",
        price_text().alias("original_price_inr"),
        F.col("discounted_price").cast("string").alias("discounted_price_inr"),
        as_text("quantity"),
        F.col("final_amount").cast("string").alias("final_amount_inr"),
        city_text().alias("customer_city"),
        "customer_state",
        "customer_tier",
        F.when(product() % 9 != 0, F.col("customer_age_group")).alias("customer_age_group"),
        F.when(F.col("is_prime_member"), "Yes").otherwise("n").alias("is_prime_member"),
        as_text("is_festival_sale"),
        "festival_name",
        payment_text().alias("payment_method"),
        F.concat(days(), F.lit(" days")).alias("delivery_days"),
        F.concat(F.col("customer_rating").cast("string"), F.lit("/5")).alias("customer_rating"),
        as_text("product_rating"),
        "return_status",
    )
    return text.withColumnRenamed("row_id", "transaction_id")


def dirty_text(sales: DataFrame) -> DataFrame:
    """Raw text with raised prices, repeated rows, and amounts that carry signs and exponents."""
    price = F.col("original_price")
    higher = F.when(F.col("l_linenumber") == 7, price * 10).otherwise(price)
    raw = raw_text(with_copies(sales.withColumn("original_price", higher.cast("decimal(18,2)"))))
    amount, number = F.col("final_amount_inr"), F.col("product_id").cast("int")
    written = F.when(number % 5 == 1, F.concat(F.lit("-"), amount)).when(
        number % 5 == 2, F.concat(F.lit(" "), amount, F.lit("e0 "))
    )
    return raw.withColumn("final_amount_inr", F.coalesce(written, amount)).withColumn(
        "quantity", F.when(number % 40 == 3, "Infinity").otherwise(F.col("quantity"))
    )


add("clean_sales_summary", RAW_SOURCE,
    lambda sales: cleaning.clean_sales(dirty_text(sales)).groupBy(
        "order_year", "customer_age_group", "payment_method").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("original_price").alias("priced"),
        F.sum("original_price").alias("price_total"),
        F.sum(F.signum(F.col("final_amount").cast("double"))).alias("signs"),
        F.count("quantity").alias("counted"),
        F.count_if("is_prime_member").alias("members"),
        F.sum("delivery_days").alias("days"),
        F.sum("customer_rating").alias("rating_total"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if(F.col("duplicate_type") == "bulk_order").alias("bulk_orders"),
        F.count_if(F.col("duplicate_type") == "error_duplicate").alias("error_duplicates"),
        F.count_if("price_outlier_iqr").alias("iqr_outliers"),
        F.count_if("price_outlier_3_sigma").alias("sigma_outliers"),
        F.count_if(F.col("customer_city") == "Mumbai").alias("mumbai"),
        F.count_if(F.col("category") == "Electronics").alias("electronics"),
        F.count_if(F.col("return_status") == "Returned").alias("returned")), f"""
WITH o AS (SELECT *, transaction_id || '-' || l_linenumber || '-' || l_suppkey AS row_id,
    CAST(CASE WHEN l_linenumber = 7 THEN original_price * 10 ELSE original_price END
      AS DECIMAL(18,2)) AS price FROM sales),
  e AS (SELECT o.* REPLACE (CASE WHEN copy = 1 AND product_id % 100 = 0 THEN quantity + 1
      ELSE quantity END AS quantity, CASE WHEN copy = 1 THEN row_id || '-dup' ELSE row_id END
      AS row_id) FROM o CROSS JOIN (VALUES (0), (1)) v(copy)
      WHERE copy = 0 OR product_id % 50 = 0),
  p AS (SELECT * REPLACE (CASE WHEN product_id % 40 <> 3 THEN quantity END AS quantity),
      CASE WHEN product_id % 4 <> 3 THEN price END AS p,
      CASE WHEN product_id % 4 <> 3 THEN order_date END AS d,
      CASE WHEN product_id % 5 = 1 THEN -1 ELSE 1 END * round_even(final_amount, 2) AS f,
      round_even(discounted_price, 2) AS c FROM e),
  q AS (SELECT subcategory, brand, quantile_cont(CAST(p AS DOUBLE), 0.25) AS q1,
      quantile_cont(CAST(p AS DOUBLE), 0.75) AS q3, avg(CAST(p AS DOUBLE)) AS m,
      stddev_samp(CAST(p AS DOUBLE)) AS s FROM p GROUP BY 1, 2),
  k AS (SELECT *, count(*) OVER g AS n, CAST(sum(quantity) OVER g AS DOUBLE) AS tq,
      CAST(sum(f) OVER g AS DOUBLE) AS ta, first_value(quantity) OVER h AS q0,
      first_value(CAST(f AS DOUBLE)) OVER h AS f0
    FROM p JOIN q USING (subcategory, brand)
    WINDOW g AS (PARTITION BY d, customer_id, product_id, p, c, f),
      h AS (PARTITION BY d, customer_id, product_id, p, c, f ORDER BY row_id)),
  t AS (SELECT *, CASE WHEN n = 1 OR d IS NULL OR p IS NULL OR c IS NULL OR f IS NULL THEN 'normal'
      WHEN q0 <> 0 AND abs(tq * (f0 / q0) - ta) < 0.01 THEN 'bulk_order'
      ELSE 'error_duplicate' END AS kind FROM k)
SELECT {I('year(d)')} AS order_year,
  CASE WHEN product_id % 9 <> 0 THEN customer_age_group ELSE '26-35' END AS customer_age_group,
  CASE WHEN product_id % 7 <> 6 THEN payment_method END AS payment_method, count(*) AS "rows",
  count(p) AS priced, CAST(sum(p) AS DOUBLE) AS price_total,
  CAST(sum(CASE WHEN f > 0 THEN 1 WHEN f < 0 THEN -1 ELSE 0 END) AS DOUBLE) AS signs,
  count(quantity) AS counted, count(*) FILTER (is_prime_member) AS members,
  {R('sum(delivery_days)')} AS days, {R('sum(customer_rating)')} AS rating_total,
  count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (kind = 'bulk_order') AS bulk_orders,
  count(*) FILTER (kind = 'error_duplicate') AS error_duplicates,
  count(*) FILTER (p < q1 - 1.5 * (q3 - q1) OR p > q3 + 1.5 * (q3 - q1)) AS iqr_outliers,
  count(*) FILTER (s > 0 AND (p < m - 3 * s OR p > m + 3 * s)) AS sigma_outliers,
  count(*) FILTER (product_id % 8 = 0) AS mumbai,
  count(*) FILTER (product_id % 5 < 2) AS electronics,
  count(*) FILTER (return_status = 'Returned') AS returned
FROM t GROUP BY 1, 2, 3""")  # fmt: skip
add("clean_sales_final_fills", RAW_SOURCE,
    lambda sales: cleaning.fill_missing(cleaning.type_columns(raw_text(sales)), final=True).groupBy(
        "payment_method").agg(F.count(F.lit(1)).alias("rows"),
        F.min("customer_rating").alias("lowest_rating"),
        F.count_if(F.col("customer_rating") == -1).alias("unrated")), f"""
SELECT CASE WHEN product_id % 7 <> 6 THEN payment_method ELSE 'Not define' END AS payment_method,
  count(*) AS "rows", {R('min(coalesce(customer_rating, -1))')} AS lowest_rating,
  count(*) FILTER (customer_rating IS NULL) AS unrated FROM sales GROUP BY 1""")  # fmt: skip
add("clean_catalogue", "product_id l_suppkey", lambda sales: cleaning.clean_catalogue(
    sales.select("product_id", F.when(F.col("product_id") % 3 == 0, "True").otherwise("False").alias(
        "is_prime_eligible")).distinct()).groupBy("is_prime_eligible").agg(
        F.count(F.lit(1)).alias("products")), f"""
SELECT {I('CASE WHEN product_id % 3 = 0 THEN 1 ELSE 0 END')} AS is_prime_eligible,
  count(DISTINCT product_id) AS products FROM sales GROUP BY 1""")  # fmt: skip
