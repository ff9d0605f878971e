"""Report analyses: revenue, payments, categories, customers, places, festivals, prices."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from checks.registry import (
    BOX, CORR, DENSITY, DIV, HIST, I, MEAN, MONTH_NAME, QTY, R, REV, add,
)
from orderlens.plans import (
    brands, categories, customers, festivals, geography, health, journeys, lifecycle, operations,
    payments, pricing, ratings, revenue,
)
from orderlens.sources.star import ROW_ORDER

FIRST, LAST = 1995, 2001  # the years the given tables cover
ROWS_IN_ORDER = " ".join(ROW_ORDER)
ORDER_SQL = ", ".join(ROW_ORDER)

# ---- Revenue and season -------------------------------------------------------------------
BY_YEAR = "y AS (SELECT order_year, sum(final_amount) AS r FROM sales GROUP BY order_year)"
add("yearly_revenue", "order_year final_amount", revenue.yearly_revenue, f"""
WITH {BY_YEAR}, p AS (SELECT *, lag(r) OVER (ORDER BY order_year) AS before FROM y)
SELECT {I('order_year')} AS order_year, CAST(r AS DOUBLE) AS revenue,
  {R('(' + DIV('r - before', 'before') + ') * 100')} AS yoy_percent FROM p""")  # fmt: skip
add("revenue_trend_line", "order_year final_amount", revenue.revenue_trend, f"""
WITH {BY_YEAR} SELECT {R('regr_slope(CAST(r AS DOUBLE), order_year)', 1)} AS slope,
  {R('regr_intercept(CAST(r AS DOUBLE), order_year)', 0)} AS intercept FROM y""",
    digits={"slope": 1, "intercept": 0})
add("monthly_revenue", "order_year order_month final_amount", revenue.monthly_revenue, f"""
SELECT {I('order_year')} AS order_year, {I('order_month')} AS order_month, {REV}
FROM sales GROUP BY order_year, order_month""")  # fmt: skip
CELLS = ", ".join(
    "CAST(coalesce(sum(CASE WHEN order_month = {m} THEN final_amount END), 0) AS DOUBLE) AS m{m}"
    .format(m=m) for m in range(1, 13)
)
add("revenue_heatmap", "order_year order_month final_amount", revenue.revenue_heatmap, f"""
SELECT {I('order_year')} AS order_year, {CELLS} FROM sales GROUP BY order_year""")  # fmt: skip
MILLIONS = ", ".join(
    R(f"sum(CASE WHEN order_month = {m} THEN final_amount END) / 1000000.0") + f" AS m{m}"
    for m in range(1, 13)
)
add("revenue_heatmap_millions", "order_year order_month final_amount",
    partial(revenue.revenue_heatmap, millions=True), f"""
SELECT {I('order_year')} AS order_year, {MILLIONS} FROM sales GROUP BY order_year""")  # fmt: skip
add("month_totals", "order_month final_amount", revenue.month_totals, f"""
SELECT {I('order_month')} AS order_month, {REV}, {MONTH_NAME} AS month_name
FROM sales GROUP BY order_month""")  # fmt: skip
add("peak_month", "order_month final_amount", revenue.peak_month, f"""
SELECT {I('order_month')} AS order_month, {REV}, {MONTH_NAME} AS month_name
FROM sales GROUP BY order_month ORDER BY sum(final_amount) DESC, order_month LIMIT 1""")  # fmt: skip
add("category_month_share", "category order_month final_amount", revenue.category_month_share, f"""
WITH t AS (SELECT category, order_month, sum(final_amount) AS r FROM sales GROUP BY ALL)
SELECT category, {I('order_month')} AS order_month, CAST(r AS DOUBLE) AS revenue,
  {R('CAST(r AS DOUBLE) / CAST(sum(r) OVER (PARTITION BY category) AS DOUBLE)')}
    AS normalized_sales FROM t""")  # fmt: skip
add("category_peak_month", "category order_month final_amount", revenue.category_peak_month, f"""
WITH t AS (SELECT category, order_month, sum(final_amount) AS r FROM sales GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY r DESC, order_month) AS k FROM t)
SELECT category, {I('order_month')} AS order_month, CAST(r AS DOUBLE) AS revenue,
  {MONTH_NAME} AS month_name FROM n WHERE k = 1""")  # fmt: skip
add("month_summary", "order_date final_amount", revenue.month_summary, f"""
SELECT strftime(order_date, '%Y-%m') AS period_month, {REV} FROM sales GROUP BY 1""")  # fmt: skip

# ---- Payment methods -----------------------------------------------------------------------
YEARS = {"first": FIRST, "last": LAST}
add("payment_share_by_year", "order_year payment_method transaction_id",
    partial(payments.payment_share, **YEARS), f"""
WITH c AS (SELECT order_year, payment_method, count(transaction_id) AS n FROM sales
  WHERE order_year BETWEEN {FIRST} AND {LAST} AND payment_method IS NOT NULL GROUP BY ALL)
SELECT {I('order_year')} AS order_year, payment_method, n AS transactions,
  {R('n / CAST(sum(n) OVER (PARTITION BY order_year) AS DOUBLE)')} AS share FROM c""")  # fmt: skip
# Years beyond the data check that empty years are listed without a share.
GRID = f"""l AS (SELECT order_year, CASE WHEN payment_method IN
    ('UPI', 'COD', 'Debit Card', 'Credit Card', 'Net Banking') THEN payment_method
    ELSE 'Other' END AS payment_method FROM sales),
  c AS (SELECT order_year, payment_method, count(*) AS n FROM l GROUP BY ALL),
  g AS (SELECT DISTINCT y.y AS order_year, payment_method
        FROM c, (SELECT unnest(range({FIRST - 1}, {LAST + 2})) AS y) y),
  f AS (SELECT order_year, payment_method, coalesce(n, 0) AS n,
          sum(coalesce(n, 0)) OVER (PARTITION BY order_year) AS whole
        FROM g LEFT JOIN c USING (order_year, payment_method))"""
WIDE_YEARS = {"first": FIRST - 1, "last": LAST + 1}
add("payment_focus_share", "order_year payment_method",
    partial(payments.focus_share, **WIDE_YEARS), f"""
WITH {GRID} SELECT {I('order_year')} AS order_year, payment_method, n AS transactions,
  {R('CASE WHEN whole > 0 THEN CAST(n AS DOUBLE) / CAST(whole AS DOUBLE) * 100 END')}
    AS share_percent FROM f""")  # fmt: skip
add("payment_dominant_method", "order_year payment_method", payments.dominant_method, f"""
WITH c AS (SELECT order_year, payment_method, count(*) AS n FROM sales GROUP BY ALL),
  k AS (SELECT *, sum(n) OVER (PARTITION BY order_year) AS whole, row_number() OVER
    (PARTITION BY order_year ORDER BY n DESC, payment_method) AS place FROM c)
SELECT {I('order_year')} AS order_year, payment_method,
  {R('CAST(n AS DOUBLE) / CAST(whole AS DOUBLE) * 100')} AS share_percent
FROM k WHERE place = 1""")  # fmt: skip
add("payment_share_change", "order_year payment_method",
    partial(payments.share_change, **YEARS), f"""
WITH c AS (SELECT order_year, payment_method, count(*) AS n FROM sales GROUP BY ALL),
  s AS (SELECT *, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY order_year) AS DOUBLE) * 100
    AS p FROM c)
SELECT payment_method, {R(f'max(CASE WHEN order_year = {FIRST} THEN p END)')} AS first_share,
  {R(f'max(CASE WHEN order_year = {LAST} THEN p END)')} AS last_share
FROM s WHERE payment_method IN ('UPI', 'COD') GROUP BY payment_method""")  # fmt: skip
add("payment_wallet_share", "order_year payment_method", payments.wallet_share, f"""
WITH c AS (SELECT order_year, CASE payment_method WHEN 'UPI' THEN 'UPI' WHEN 'COD' THEN 'COD'
    WHEN 'Debit Card' THEN 'Debit Card' WHEN 'Credit Card' THEN 'Credit Card'
    WHEN 'Net Banking' THEN 'Net Banking' WHEN 'Wallet' THEN 'Digital Wallet'
    ELSE 'Other' END AS payment_method, count(*) AS n FROM sales GROUP BY ALL)
SELECT {I('order_year')} AS order_year, payment_method, n AS transactions,
  {R('CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY order_year) AS DOUBLE) * 100')}
    AS share_percent FROM c""")  # fmt: skip

# ---- Categories ------------------------------------------------------------------------------
SUBCATEGORY = "coalesce(subcategory, 'Unknown')"
add("category_revenue", "subcategory final_amount", categories.category_revenue, f"""
SELECT {SUBCATEGORY} AS category, {REV} FROM sales GROUP BY 1""")  # fmt: skip
add("category_share_top6_others", "subcategory final_amount", categories.category_share, f"""
WITH t AS (SELECT {SUBCATEGORY} AS category, sum(final_amount) AS r FROM sales GROUP BY 1),
  n AS (SELECT *, row_number() OVER (ORDER BY r DESC, category) AS k FROM t),
  p AS (SELECT category, r FROM n WHERE k <= 6 UNION ALL
        SELECT 'Others', coalesce(sum(r), 0) FROM n WHERE k > 6)
SELECT category, CAST(r AS DOUBLE) AS revenue,
  {R('CAST(r AS DOUBLE) / CAST((SELECT sum(r) FROM t) AS DOUBLE) * 100')} AS share_percent
FROM p""")  # fmt: skip
add("category_tree", "category subcategory final_amount", categories.category_tree, f"""
SELECT CASE WHEN grouping(main) = 1 THEN 'All' ELSE main END AS main_category,
  CASE WHEN grouping(sub) = 1 THEN 'All' ELSE sub END AS category,
  {I('2 - grouping(main) - grouping(sub)')} AS level, {REV}
FROM (SELECT coalesce(category, 'Unknown') AS main, {SUBCATEGORY} AS sub, final_amount
      FROM sales) GROUP BY ROLLUP (main, sub)""")  # fmt: skip
add("category_growth", "subcategory order_year final_amount", categories.category_growth, f"""
WITH t AS (SELECT {SUBCATEGORY} AS category, order_year, sum(final_amount) AS r
           FROM sales GROUP BY ALL),
  g AS (SELECT c.category, y.order_year FROM (SELECT DISTINCT category FROM t) c,
          (SELECT DISTINCT order_year FROM t) y),
  f AS (SELECT category, order_year, coalesce(r, 0) AS r FROM g LEFT JOIN t
          USING (category, order_year)),
  p AS (SELECT *, lag(r) OVER (PARTITION BY category ORDER BY order_year) AS before FROM f)
SELECT category, {I('order_year')} AS order_year, CAST(r AS DOUBLE) AS revenue,
  {R('CASE WHEN before <> 0 THEN CAST(r - before AS DOUBLE) / CAST(before AS DOUBLE) * 100 END')}
    AS growth_percent FROM p""")  # fmt: skip

# ---- Membership and age ------------------------------------------------------------------------
MEMBER = "CASE WHEN is_prime_member THEN 'Prime' ELSE 'Non-Prime' END"
add("member_order_value", "is_prime_member final_amount", customers.member_order_value, f"""
SELECT {MEMBER} AS member, {R(MEAN('final_amount'))} AS average_value
FROM sales GROUP BY 1""")  # fmt: skip
add("member_order_frequency", "is_prime_member customer_id transaction_id",
    customers.member_order_frequency, f"""
WITH c AS (SELECT {MEMBER} AS member, customer_id, count(DISTINCT transaction_id) AS n
           FROM sales GROUP BY ALL)
SELECT member, {R(MEAN('n'))} AS average_orders FROM c GROUP BY member""")  # fmt: skip
add("member_category_share", "is_prime_member category final_amount",
    customers.member_category_share, f"""
WITH t AS (SELECT {MEMBER} AS member, category, sum(final_amount) AS r FROM sales GROUP BY ALL)
SELECT member, category, CAST(r AS DOUBLE) AS revenue,
  {R('CAST(r AS DOUBLE) / CAST(sum(r) OVER (PARTITION BY member) AS DOUBLE) * 100')}
    AS share_percent FROM t""")  # fmt: skip
add("age_category_share", "customer_age_group subcategory final_amount",
    customers.age_category_share, f"""
WITH t AS (SELECT customer_age_group, subcategory, sum(final_amount) AS r FROM sales GROUP BY ALL)
SELECT customer_age_group, subcategory, CAST(r AS DOUBLE) AS revenue,
  {R('CAST(r AS DOUBLE) / CAST(sum(r) OVER (PARTITION BY customer_age_group) AS DOUBLE) * 100')}
    AS share_percent FROM t""")  # fmt: skip
add("age_order_value", "customer_age_group transaction_id final_amount",
    customers.age_order_value, f"""
WITH o AS (SELECT customer_age_group, transaction_id, sum(final_amount) AS r
           FROM sales GROUP BY ALL)
SELECT customer_age_group, {R(MEAN('r'))} AS average_value FROM o GROUP BY 1""")  # fmt: skip
PER_AGE = """(SELECT customer_age_group, customer_id, count(DISTINCT transaction_id) AS orders
  FROM sales GROUP BY ALL)"""
add("age_order_frequency_box", "customer_age_group customer_id transaction_id",
    customers.age_order_frequency, BOX(PER_AGE, "orders", ["customer_age_group"]))

# ---- Places ------------------------------------------------------------------------------------
add("state_revenue", "customer_state final_amount", geography.state_revenue, f"""
SELECT customer_state, {REV} FROM sales GROUP BY 1""")  # fmt: skip
add("place_revenue", "customer_city customer_state customer_tier final_amount",
    geography.place_revenue, f"""
SELECT customer_city, customer_state, customer_tier, {REV} FROM sales GROUP BY ALL""")  # fmt: skip
add("city_revenue_modal_tier", "customer_city customer_tier final_amount",
    geography.city_revenue, f"""
WITH t AS (SELECT customer_city, customer_tier, count(*) AS n, sum(final_amount) AS r
           FROM sales GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY customer_city
          ORDER BY n DESC, customer_tier) AS place FROM t)
SELECT customer_city, CAST(sum(r) AS DOUBLE) AS revenue,
  max(CASE WHEN place = 1 THEN customer_tier END) AS customer_tier
FROM k GROUP BY customer_city""")  # fmt: skip
add("tier_revenue_by_year", "order_year customer_tier final_amount",
    geography.tier_revenue_by_year, f"""
SELECT {I('order_year')} AS order_year, customer_tier, {REV}
FROM sales GROUP BY order_year, customer_tier""")  # fmt: skip
add("latest_year_tier_share", "order_year customer_tier final_amount",
    geography.latest_tier_share, f"""
WITH t AS (SELECT customer_tier, sum(final_amount) AS r FROM sales
  WHERE order_year = (SELECT max(order_year) FROM sales) GROUP BY 1)
SELECT customer_tier, CAST(r AS DOUBLE) AS revenue,
  {R('CAST(r AS DOUBLE) / CAST(sum(r) OVER () AS DOUBLE) * 100')} AS share_percent FROM t""")  # fmt: skip
add("top_locations", "customer_state final_amount", partial(geography.top_locations, n=3), f"""
SELECT customer_state, {REV} FROM sales GROUP BY 1
ORDER BY sum(final_amount) DESC, customer_state LIMIT 3""")  # fmt: skip

# ---- Festivals -----------------------------------------------------------------------------------
add("festival_lift", "order_date is_festival_sale festival_name final_amount",
    festivals.festival_lift, f"""
WITH d AS (SELECT order_date, sum(final_amount) AS r FROM sales GROUP BY 1),
  f AS (SELECT DISTINCT festival_name, order_date AS day FROM sales
        WHERE is_festival_sale AND festival_name IS NOT NULL),
  w AS (SELECT festival_name, day, date_diff('day', day, order_date) AS relative_day, r
        FROM f JOIN d ON date_diff('day', day, order_date) BETWEEN -7 AND 7)
SELECT festival_name, {I('relative_day')} AS relative_day, {R(MEAN('r'))} AS average_revenue,
  count(*) AS occurrences FROM w GROUP BY festival_name, relative_day""")  # fmt: skip

# ---- Price, discount, competition ------------------------------------------------------------------
PRICE = "CAST(coalesce(discounted_price, original_price) AS DECIMAL(24,4))"
add("price_demand", "subcategory discounted_price original_price quantity discount_percent "
    "final_amount", pricing.price_demand, f"""
SELECT subcategory, {R(MEAN(PRICE))} AS average_price, {QTY},
  {R(MEAN('discount_percent'))} AS average_discount, {REV}
FROM sales GROUP BY subcategory""")  # fmt: skip
add("price_correlation", "discounted_price original_price quantity discount_percent final_amount",
    pricing.price_correlation,
    CORR(f"(SELECT {PRICE} AS price, discount_percent, quantity, final_amount FROM sales)",
         ["price", "discount_percent", "quantity", "final_amount"]))
BIN = """CASE WHEN discount_percent >= 0 AND discount_percent < 10 THEN '0-10%'
  WHEN discount_percent >= 10 AND discount_percent < 20 THEN '10-20%'
  WHEN discount_percent >= 20 AND discount_percent < 30 THEN '20-30%'
  WHEN discount_percent >= 30 AND discount_percent < 40 THEN '30-40%'
  WHEN discount_percent >= 40 AND discount_percent < 50 THEN '40-50%'
  WHEN discount_percent >= 50 AND discount_percent < 100 THEN '50%+' END"""
BINNED = f"(SELECT *, {BIN} AS discount_bin FROM sales)"
add("discount_by_year", "order_year discount_percent quantity final_amount",
    pricing.discount_by_year, f"""
WITH t AS (SELECT order_year, discount_bin, sum(quantity) AS q, sum(final_amount) AS r
           FROM {BINNED} GROUP BY ALL),
  g AS (SELECT y.order_year, b.discount_bin FROM (SELECT DISTINCT order_year FROM sales) y,
    (SELECT unnest(['0-10%', '10-20%', '20-30%', '30-40%', '40-50%', '50%+']) AS discount_bin) b)
SELECT {I('order_year')} AS order_year, discount_bin, {I('coalesce(q, 0)')} AS quantity,
  CAST(coalesce(r, 0) AS DOUBLE) AS revenue
FROM g LEFT JOIN t USING (order_year, discount_bin)""")  # fmt: skip
add("discount_over_time", "order_year order_month subcategory discount_percent quantity "
    "final_amount", pricing.discount_over_time, f"""
SELECT {I('order_year')} AS order_year, {I('order_month')} AS order_month, subcategory,
  {R(MEAN('discount_percent'))} AS average_discount, {QTY}, {REV},
  make_date(order_year, order_month, 1) AS month_start
FROM sales GROUP BY order_year, order_month, subcategory""")  # fmt: skip
add("discount_quantity", "discount_percent subcategory quantity", pricing.discount_quantity, f"""
SELECT discount_bin, subcategory, {R(MEAN('quantity'))} AS average_quantity
FROM {BINNED} WHERE discount_bin IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
add("discount_revenue_box", "discount_percent subcategory final_amount",
    pricing.discount_revenue_box,
    BOX(BINNED, "final_amount", ["discount_bin", "subcategory"]))
add("discount_correlation", "subcategory discount_percent quantity final_amount",
    pricing.discount_correlation,
    CORR(f"""(SELECT subcategory, {MEAN('discount_percent')} AS average_discount,
        sum(quantity) AS quantity, CAST(sum(final_amount) AS DOUBLE) AS revenue
        FROM sales GROUP BY 1)""", ["average_discount", "quantity", "revenue"]))  # fmt: skip
TRIMMED = """(SELECT * FROM sales WHERE final_amount > 0 AND CAST(final_amount AS DOUBLE) <
  (SELECT quantile_cont(CAST(final_amount AS DOUBLE), 0.99) FROM sales))"""
add("brand_price_histogram", "subcategory brand final_amount", pricing.brand_price_histogram,
    HIST(TRIMMED, "final_amount", 30, ["subcategory", "brand"]))
POSITION = f"""t AS (SELECT subcategory, brand, sum(quantity) AS q,
    {MEAN('final_amount')} AS average_price FROM {TRIMMED} GROUP BY subcategory, brand),
  p AS (SELECT *, sum(q) OVER (PARTITION BY subcategory) AS whole FROM t)"""
add("brand_position", "subcategory brand quantity final_amount", pricing.brand_position, f"""
WITH {POSITION} SELECT subcategory, brand, {I('q')} AS quantity,
  {R('average_price', 8)} AS average_price, {I('whole')} AS category_quantity,
  {R('CAST(q AS DOUBLE) / CAST(whole AS DOUBLE)')} AS market_share FROM p""",
    digits={"average_price": 8})
for matrix, cell in (
    ("market_share", "CAST(q AS DOUBLE) / CAST(whole AS DOUBLE)"),
    ("average_price", "average_price"),
):
    add(f"brand_matrix_{matrix}", "subcategory brand quantity final_amount",
        partial(pricing.brand_matrix, value=matrix), f"""
WITH {POSITION}, c AS (SELECT brand, subcategory, {cell} AS v FROM p)
SELECT brand, subcategory, {R('coalesce(v, 0)', 8)} AS {matrix}
FROM (SELECT DISTINCT brand FROM c) CROSS JOIN (SELECT DISTINCT subcategory FROM c)
  LEFT JOIN c USING (brand, subcategory)""",
        digits={matrix: 8})

# ---- Delivery and returns ---------------------------------------------------------------------------
RATED = """(SELECT * FROM sales WHERE delivery_days IS NOT NULL AND customer_rating IS NOT NULL)"""
BUSY = f"""(SELECT * FROM {RATED} WHERE customer_city IN (SELECT customer_city FROM {RATED}
  GROUP BY 1 ORDER BY count(*) DESC, customer_city LIMIT 10))"""
DELIVERY = "delivery_days customer_rating"
for place, source, key in (
    ("tier", RATED, "customer_tier"),
    ("city", BUSY, "customer_city"),
):
    add(f"delivery_days_box_by_{place}", f"{DELIVERY} {key}",
        getattr(operations, f"delivery_days_by_{place}"),
        BOX(source, "delivery_days", [key]))
    add(f"on_time_by_{place}", f"{DELIVERY} {key}", getattr(operations, f"on_time_by_{place}"), f"""
SELECT {key}, {R('avg(CASE WHEN delivery_days <= 5 THEN 1.0 ELSE 0.0 END) * 100')}
  AS on_time_percent FROM {source} GROUP BY 1""")  # fmt: skip
    add(f"satisfaction_by_{place}", f"{DELIVERY} {key}",
        getattr(operations, f"satisfaction_by_{place}"), f"""
SELECT {key}, {R(MEAN('delivery_days'))} AS average_days,
  {R(MEAN('customer_rating'))} AS average_rating FROM {source} GROUP BY 1""")  # fmt: skip
add("delivery_with_median_fill", "discounted_price customer_tier customer_rating",
    lambda sales: operations.rated_deliveries(
        sales.withColumnRenamed("discounted_price", "delivery_days"), fill_days=True
    ).groupBy("customer_tier").agg(
        F.count("delivery_days").alias("rows"), F.max("delivery_days").alias("highest"),
        F.round(F.avg("delivery_days"), 2).alias("average")), f"""
WITH m AS (SELECT quantile_cont(CAST(discounted_price AS DOUBLE), 0.5) AS med FROM sales),
  x AS (SELECT customer_tier, coalesce(CAST(discounted_price AS DOUBLE), med) AS v
        FROM sales, m WHERE customer_rating IS NOT NULL)
SELECT customer_tier, count(v) AS "rows", {R('max(v)')} AS highest, {R('avg(v)', 2)} AS average
FROM x GROUP BY 1""")  # fmt: skip
BOTH = """(SELECT *, coalesce(return_status = 'Returned', FALSE) AS returned FROM sales
  WHERE customer_rating IS NOT NULL AND product_rating IS NOT NULL)"""
RATINGS = "customer_rating product_rating return_status"
RATE = R("avg(CASE WHEN returned THEN 1.0 ELSE 0.0 END)") + " AS return_rate"
add("return_rate_overall", RATINGS, operations.return_rate, f"SELECT {RATE} FROM {BOTH}")
add("return_rate_by_category", f"{RATINGS} category",
    lambda sales: operations.return_rate(sales, "category"),
    f"SELECT category, {RATE} FROM {BOTH} GROUP BY 1")
add("return_rate_by_subcategory", f"{RATINGS} subcategory",
    lambda sales: operations.return_rate(sales, "subcategory"),
    f"SELECT subcategory, {RATE} FROM {BOTH} GROUP BY 1")
for measured in ("customer_rating", "product_rating", "final_amount"):
    extra = "" if measured in RATINGS else f" {measured}"
    add(f"return_box_{measured}", RATINGS + extra,
        partial(operations.return_box, value=measured), BOX(BOTH, measured, ["returned"]))
add("return_correlation", f"{RATINGS} final_amount discount_percent quantity",
    operations.return_correlation,
    CORR(f"(SELECT * REPLACE (CAST(returned AS INTEGER) AS returned) FROM {BOTH})",
         ["returned", "customer_rating", "product_rating", "final_amount", "discount_percent",
          "quantity"]))

# ---- Brands --------------------------------------------------------------------------------------------
add("brand_performance", "brand final_amount quantity", brands.brand_performance, f"""
SELECT brand, {REV}, {QTY}, {R('''CAST(sum(final_amount) AS DOUBLE)
    / CAST((SELECT sum(final_amount) FROM sales) AS DOUBLE) * 100''')} AS market_share
FROM sales GROUP BY brand""")  # fmt: skip
add("brand_by_month", "order_year order_month brand final_amount", brands.brand_by_month, f"""
SELECT {I('order_year')} AS order_year, {I('order_month')} AS order_month, brand, {REV},
  make_date(order_year, order_month, 1) AS month_start
FROM sales GROUP BY order_year, order_month, brand""")  # fmt: skip
add("brand_by_category", "subcategory brand final_amount", brands.brand_by_category, f"""
SELECT subcategory, brand, {REV} FROM sales GROUP BY 1, 2""")  # fmt: skip
add("brand_top5_by_category", "subcategory brand final_amount",
    partial(brands.brand_by_category, top=5), f"""
WITH t AS (SELECT subcategory, brand, sum(final_amount) AS r FROM sales GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY subcategory ORDER BY r DESC, brand) AS p FROM t)
SELECT subcategory, brand, CAST(r AS DOUBLE) AS revenue FROM k WHERE p <= 5""")  # fmt: skip

# ---- Cohorts and lifetime value ---------------------------------------------------------------------------
add("cohort_retention_yearly", "customer_id order_year", customers.yearly_cohorts, f"""
WITH a AS (SELECT DISTINCT customer_id, order_year FROM sales),
  c AS (SELECT *, min(order_year) OVER (PARTITION BY customer_id) AS cohort_year FROM a),
  n AS (SELECT cohort_year, order_year - cohort_year + 1 AS cohort_index, count(*) AS customers
        FROM c GROUP BY ALL)
SELECT {I('n.cohort_year')} AS cohort_year, {I('n.cohort_index')} AS cohort_index, n.customers,
  {R('CAST(n.customers AS DOUBLE) / CAST(s.customers AS DOUBLE)')} AS retention
FROM n LEFT JOIN n s ON s.cohort_year = n.cohort_year AND s.cohort_index = 1""")  # fmt: skip
add("cohort_monthly", "customer_id order_date", customers.monthly_cohorts, """
WITH f AS (SELECT customer_id, min(order_date) AS d FROM sales GROUP BY 1)
SELECT strftime(d, '%Y-%m') AS first_month, strftime(order_date, '%Y-%m') AS order_month,
  count(DISTINCT customer_id) AS customers
FROM sales JOIN f USING (customer_id) GROUP BY 1, 2""")  # fmt: skip
CLV = """(SELECT customer_id, sum(final_amount) AS clv, min(order_year) AS acquisition_year
  FROM sales GROUP BY 1)"""
LIFETIME = "customer_id order_year final_amount"
add("lifetime_value", LIFETIME, customers.lifetime_value, f"""
SELECT {I('customer_id')} AS customer_id, CAST(clv AS DOUBLE) AS clv,
  {I('acquisition_year')} AS acquisition_year FROM {CLV}""")  # fmt: skip
add("lifetime_value_box_by_year", LIFETIME, customers.lifetime_value_by_year,
    BOX(CLV.replace("min(order_year)", I("min(order_year)")), "clv", ["acquisition_year"]))
add("lifetime_value_histogram", LIFETIME, customers.lifetime_value_histogram, HIST(CLV, "clv", 50))
add("lifetime_value_density", LIFETIME, customers.lifetime_value_density,
    DENSITY(CLV, "clv", 200, digits=12), digits={"density": 12})

# ---- Ratings --------------------------------------------------------------------------------------------------
add("rating_histogram", "product_rating", ratings.rating_histogram,
    HIST("sales", "product_rating", 20))
add("rating_histogram_by_subcategory", "product_rating subcategory",
    partial(ratings.rating_histogram, by_subcategory=True),
    HIST("sales", "product_rating", 20, ["subcategory"]))
add("rating_density", "product_rating", ratings.rating_density,
    DENSITY("sales", "product_rating", 200), digits={"density": 5})
add("rating_density_by_subcategory", "product_rating subcategory",
    partial(ratings.rating_density, by_subcategory=True),
    DENSITY("sales", "product_rating", 200, ["subcategory"]), digits={"density": 5})
PRODUCTS = f"""(SELECT product_id, subcategory, {MEAN('product_rating')} AS average_rating,
  sum(quantity) AS quantity, CAST(sum(final_amount) AS DOUBLE) AS revenue
  FROM sales WHERE product_rating IS NOT NULL GROUP BY product_id, subcategory)"""
RATED_PRODUCTS = "product_id subcategory product_rating quantity final_amount"
add("product_ratings", RATED_PRODUCTS, ratings.product_ratings, f"""
SELECT {I('product_id')} AS product_id, subcategory, {R('average_rating')} AS average_rating,
  {I('quantity')} AS quantity, revenue FROM {PRODUCTS}""")  # fmt: skip
add("rating_correlation", RATED_PRODUCTS, ratings.rating_correlation,
    CORR(PRODUCTS, ["average_rating", "quantity", "revenue"]))
add("rating_by_price", "product_rating original_price quantity final_amount",
    ratings.rating_by_price, f"""
WITH x AS (SELECT * FROM sales WHERE product_rating IS NOT NULL),
  b AS (SELECT unnest(['0-500', '500-1000', '1000-2000', '2000-5000', '5000-10000', '10000+'])
          AS price_bin, unnest([0, 500, 1000, 2000, 5000, 10000]) AS lo,
          unnest([500, 1000, 2000, 5000, 10000, NULL]) AS hi),
  e AS (SELECT price_bin, lo, coalesce(hi, (SELECT max(original_price) FROM x)) AS hi FROM b)
SELECT price_bin, {R(MEAN('product_rating'))} AS average_rating,
  {I('coalesce(sum(quantity), 0)')} AS quantity,
  CAST(coalesce(sum(final_amount), 0) AS DOUBLE) AS revenue
FROM e LEFT JOIN x ON original_price >= lo AND original_price < hi GROUP BY price_bin""")  # fmt: skip

# ---- Journeys ------------------------------------------------------------------------------------------------------
GAPS = f"""(SELECT date_diff('day', lag(order_date) OVER (PARTITION BY customer_id
  ORDER BY {ORDER_SQL}), order_date) AS days FROM sales)"""
add("days_between_orders", "customer_id order_date", journeys.days_between_orders,
    HIST(GAPS, "days", 50))
add("days_between_orders_density", "customer_id order_date", journeys.days_between_orders_density,
    DENSITY(GAPS, "days", 200, digits=8), digits={"density": 8})
PAIRS = f"""s AS (SELECT subcategory, lag(subcategory) OVER (PARTITION BY customer_id
    ORDER BY {ORDER_SQL}) AS previous FROM sales),
  c AS (SELECT previous, subcategory AS following, count(*) AS n FROM s
        WHERE previous IS NOT NULL GROUP BY ALL),
  p AS (SELECT *, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY previous) AS DOUBLE) AS p
        FROM c)"""
JOURNEY = f"customer_id subcategory {ROWS_IN_ORDER}"
add("category_transitions", JOURNEY,
    partial(journeys.category_transitions, order=ROW_ORDER), f"""
WITH {PAIRS} SELECT previous, following, n AS count, {R('p')} AS probability FROM p""")  # fmt: skip
add("transition_matrix", JOURNEY,
    partial(journeys.transition_matrix, order=ROW_ORDER), f"""
WITH {PAIRS} SELECT previous, following, {R('coalesce(p, 0)')} AS probability
FROM (SELECT DISTINCT previous FROM p) CROSS JOIN (SELECT DISTINCT following FROM p)
  LEFT JOIN p USING (previous, following)""")  # fmt: skip
JOURNEYS = f"""n AS (SELECT customer_id, subcategory,
    row_number() OVER (PARTITION BY customer_id ORDER BY {ORDER_SQL}) AS k,
    count(*) OVER (PARTITION BY customer_id) AS c FROM sales),
  j AS (SELECT customer_id, CASE WHEN max(c) >= 5 THEN 'Loyal' ELSE 'New' END AS customer_status,
    max(CASE WHEN k = 1 THEN subcategory END) AS first_category,
    max(CASE WHEN k = c THEN subcategory END) AS last_category FROM n GROUP BY customer_id)"""
add("customer_journeys", JOURNEY, partial(journeys.customer_journeys, order=ROW_ORDER), f"""
WITH {JOURNEYS} SELECT customer_status, first_category, last_category, count(*) AS count
FROM j GROUP BY 1, 2, 3""")  # fmt: skip
add("journey_matrix", JOURNEY,
    partial(journeys.journey_matrix, order=ROW_ORDER), f"""
WITH {JOURNEYS}, c AS (SELECT first_category, last_category, count(*) AS n FROM j GROUP BY ALL)
SELECT first_category, last_category, coalesce(n, 0) AS count
FROM (SELECT DISTINCT first_category FROM c) CROSS JOIN (SELECT DISTINCT last_category FROM c)
  LEFT JOIN c USING (first_category, last_category)""")  # fmt: skip
add("first_category_counts", JOURNEY,
    partial(journeys.first_category_counts, order=ROW_ORDER), f"""
WITH {JOURNEYS} SELECT customer_status, first_category, count(*) AS count
FROM j GROUP BY 1, 2""")  # fmt: skip

# ---- Product lifecycle ------------------------------------------------------------------------------------------------
AGED = """a AS (SELECT *, (year(order_date) * 12 + month(order_date))
    - min(year(order_date) * 12 + month(order_date)) OVER (PARTITION BY product_id) AS age,
    min(order_date) OVER (PARTITION BY product_id) AS launch_date FROM sales)"""
add("months_since_launch", "transaction_id l_linenumber product_id order_date quantity",
    lifecycle.months_since_launch, f"""
WITH {AGED} SELECT transaction_id, {I('l_linenumber')} AS l_linenumber,
  {I('product_id')} AS product_id, order_date, {I('quantity')} AS quantity, launch_date,
  {I('age')} AS months_since_launch FROM a""")  # fmt: skip
add("quantity_by_year", "subcategory order_year quantity", lifecycle.quantity_by_year, f"""
SELECT subcategory, {I('order_year')} AS order_year, {QTY}
FROM sales GROUP BY subcategory, order_year""")  # fmt: skip
add("product_quantity_by_year", "product_id subcategory order_year quantity",
    lifecycle.product_quantity_by_year, f"""
SELECT {I('product_id')} AS product_id, subcategory, {I('order_year')} AS order_year, {QTY}
FROM sales GROUP BY product_id, subcategory, order_year""")  # fmt: skip
LAUNCH = f"""l AS (SELECT product_id, sum(quantity) AS launch_quantity,
    {MEAN('customer_rating')} AS average_rating,
    avg(CASE WHEN return_status = 'Returned' THEN 1.0 ELSE 0.0 END) AS return_rate
    FROM a WHERE age <= 3 GROUP BY product_id)"""
LAUNCH_COLUMNS = "product_id order_date quantity customer_rating return_status"
LAUNCH_CELLS = f"""{I('l.product_id')} AS product_id, {I('launch_quantity')} AS launch_quantity,
  {R('average_rating')} AS average_rating, {R('return_rate')} AS return_rate"""
add("launch_success", LAUNCH_COLUMNS, lifecycle.launch_success, f"""
WITH {AGED}, {LAUNCH} SELECT {LAUNCH_CELLS} FROM l""")  # fmt: skip
add("early_quantity_by_subcategory", "product_id subcategory order_date quantity",
    lifecycle.early_quantity, f"""
WITH {AGED}, e AS (SELECT product_id, sum(quantity) AS q FROM a WHERE age BETWEEN 0 AND 2
    GROUP BY 1), c AS (SELECT DISTINCT product_id, subcategory FROM sales)
SELECT subcategory, {R(MEAN('q'))} AS average_early_quantity
FROM e JOIN c USING (product_id) GROUP BY 1""")  # fmt: skip


def decline_sql(period: str) -> str:
    return f"""m AS (SELECT product_id, {period} AS period, sum(quantity) AS q
      FROM sales GROUP BY ALL),
    r AS (SELECT *, CAST(sum(q) OVER w AS DOUBLE) / count(q) OVER w AS rolling,
        row_number() OVER (PARTITION BY product_id ORDER BY period DESC) AS back
      FROM m WINDOW w AS (PARTITION BY product_id ORDER BY period
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    t AS (SELECT *, lag(rolling) OVER (PARTITION BY product_id ORDER BY period) AS before
      FROM r WHERE back <= 5),
    d AS (SELECT product_id, count(*) AS periods,
        coalesce(bool_and(before > rolling), TRUE) AS is_declining FROM t GROUP BY 1)"""


for grain, period in (
    ("year_month", "year(order_date) * 12 + month(order_date)"),
    ("month_of_year", "month(order_date)"),
):
    add(f"decline_flags_{grain}", "product_id order_date quantity",
        partial(lifecycle.decline_flags, grain=grain), f"""
WITH {decline_sql(period)} SELECT {I('product_id')} AS product_id, periods, is_declining
FROM d""")  # fmt: skip
add("lifecycle_summary", LAUNCH_COLUMNS, lifecycle.lifecycle_summary, f"""
WITH {AGED}, {LAUNCH}, {decline_sql('year(order_date) * 12 + month(order_date)')}
SELECT {LAUNCH_CELLS}, periods, is_declining
FROM l LEFT JOIN d ON l.product_id = d.product_id""")  # fmt: skip
add("festival_quantity", "subcategory order_year quantity is_festival_sale",
    lifecycle.festival_quantity, f"""
SELECT subcategory, {I('order_year')} AS order_year, {QTY}
FROM sales WHERE is_festival_sale GROUP BY subcategory, order_year""")  # fmt: skip

# ---- Business health -----------------------------------------------------------------------------------------------------
add("customer_health", "customer_id order_date order_year final_amount",
    health.customer_health, f"""
WITH s AS (SELECT *, date_diff('day', order_date, lead(order_date) OVER
      (PARTITION BY customer_id ORDER BY order_date)) AS gap,
    min(order_year) OVER (PARTITION BY customer_id) AS first_year FROM sales)
SELECT {I('order_year')} AS order_year, {REV},
  count(DISTINCT customer_id) AS total_customers,
  count(DISTINCT CASE WHEN order_year = first_year THEN customer_id END) AS new_customers,
  count(DISTINCT CASE WHEN gap <= 60 THEN customer_id END) AS retained_customers
FROM s GROUP BY order_year""")  # fmt: skip
add("operations_health", "order_year delivery_days return_status", health.operations_health, f"""
SELECT {I('order_year')} AS order_year, {R(MEAN('delivery_days'))} AS average_delivery_days,
  {R("avg(CASE WHEN return_status = 'Returned' THEN 1.0 ELSE 0.0 END)")} AS return_rate
FROM sales GROUP BY order_year""")  # fmt: skip
