"""Segments, dashboard tables and building blocks."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from checks.registry import BOX, DESCRIBE, DIV, HIST, MEAN, QTY, REV, D, I, R, add
from orderlens.functions import dates
from orderlens.operators import frames, histogram, qcut, quantiles, sequences
from orderlens.plans import customers, dashboard, segments
from orderlens.sources import profile, star

# ---- Recency, frequency, monetary ---------------------------------------------------------------
RFM_COLUMNS = "customer_id order_date transaction_id final_amount"


def rfm_sql(frequency: str) -> str:
    return f"""rfm AS (SELECT customer_id,
        date_diff('day', max(order_date), (SELECT max(order_date) FROM sales)) + 1 AS recency,
        {frequency} AS frequency, sum(final_amount) AS monetary
      FROM sales WHERE customer_id IS NOT NULL GROUP BY customer_id)"""


def edges_sql(column: str, source: str = "rfm", bins: int = 5) -> str:
    """Distinct quantile edges of a column, interpolated between sorted neighbours."""
    place = f"CAST({{i}} AS DOUBLE) / {bins} * (len(v) - 1)"
    cells = ", ".join(
        f"v[CAST(floor({p}) AS BIGINT) + 1] + (v[CAST(ceil({p}) AS BIGINT) + 1]"
        f" - v[CAST(floor({p}) AS BIGINT) + 1]) * ({p} - floor({p}))"
        for p in (f"({place.format(i=i)})" for i in range(bins + 1))
    )
    return f"""edges_{column} AS (SELECT list_sort(list_distinct([{cells}])) AS e FROM
      (SELECT list_sort(list(CAST({column} AS DOUBLE))) AS v FROM {source}))"""


def value_score(column: str, descending: bool = False) -> str:
    """Number of inner edges strictly below the value, counted from 1."""
    e = f"(SELECT e FROM edges_{column})"
    below = f"""(SELECT count(*) FROM (SELECT unnest(e[2:len(e) - 1]) AS edge FROM edges_{column})
      WHERE edge < CAST({column} AS DOUBLE))"""
    return f"len({e}) - 1 - {below}" if descending else f"1 + {below}"


def rank_score(column: str, descending: bool = False) -> str:
    place = f"(row_number() OVER (ORDER BY {column}, customer_id) - 1)"
    label = f"greatest(1, CAST(ceil({place} * 5.0 / (count(*) OVER () - 1)) AS BIGINT))"
    return f"6 - {label}" if descending else label


def scored_sql(frequency: str, r: str, f: str, m: str, edges: tuple[str, ...], segment: str) -> str:
    parts = [rfm_sql(frequency), *[edges_sql(column) for column in edges]]
    return f"""WITH {', '.join(parts)},
      scored AS (SELECT *, {r} AS r, {f} AS f, {m} AS m FROM rfm),
      segmented AS (SELECT customer_id, recency, frequency, monetary, r, f, m,
        r + f + m AS total, {segment} AS segment FROM scored)"""


def steps_sql(*steps: tuple[int, str], last: str) -> str:
    whens = " ".join(f"WHEN r + f + m >= {floor} THEN '{label}'" for floor, label in steps)
    return f"CASE {whens} ELSE '{last}' END"


TABLE = f"""SELECT {I('customer_id')} AS customer_id, {I('recency')} AS recency,
  {I('frequency')} AS frequency, CAST(monetary AS DOUBLE) AS monetary, {I('r')} AS r_score,
  {I('f')} AS f_score, {I('m')} AS m_score,
  CAST(r AS VARCHAR) || CAST(f AS VARCHAR) || CAST(m AS VARCHAR) AS rfm_code,
  {I('total')} AS rfm_score, segment FROM segmented"""
COUNTS = "SELECT segment, count(*) AS count FROM segmented GROUP BY segment"
ORDERS, LINES = "count(DISTINCT transaction_id)", "count(transaction_id)"
REPORT = scored_sql(
    ORDERS, value_score("recency", True), value_score("frequency"), value_score("monetary"),
    ("recency", "frequency", "monetary"),
    steps_sql((13, "Champions"), (10, "Loyal Customers"), (7, "Potential Loyalists"),
              (5, "Needs Attention"), last="At Risk"),
)
EXPLORE = (
    LINES, value_score("recency", True), rank_score("frequency"), value_score("monetary"),
    ("recency", "monetary"),
)
EXPLORATION = scored_sql(*EXPLORE, steps_sql(
    (12, "Champions"), (9, "Loyal"), (6, "Potential Loyalist"), (4, "At Risk"), last="Lost"))
RULES = scored_sql(*EXPLORE, """CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champion'
  WHEN f >= 4 THEN 'Loyal' WHEN r <= 2 AND m >= 4 THEN 'At Risk'
  WHEN r <= 2 AND f <= 2 THEN 'Lost' ELSE 'Need Attention' END""")
DASHBOARD = scored_sql(
    ORDERS, rank_score("recency", True), rank_score("frequency"), rank_score("monetary"), (),
    steps_sql((13, "Champions"), (10, "Loyal"), (7, "Promising"), (4, "At Risk"), last="Lost"),
)

add("rfm_base", RFM_COLUMNS, segments.rfm, f"""
WITH {rfm_sql(ORDERS)} SELECT {I('customer_id')} AS customer_id, {I('recency')} AS recency,
  {I('frequency')} AS frequency, CAST(monetary AS DOUBLE) AS monetary FROM rfm""")  # fmt: skip
for column in ("recency", "frequency", "monetary"):
    add(f"rfm_describe_{column}", RFM_COLUMNS,
        lambda sales, c=column: quantiles.describe(segments.rfm(sales), c),
        f"WITH {rfm_sql(ORDERS)} {DESCRIBE('rfm', column)}")
for name, build, sql in (
    ("report", segments.rfm_report, REPORT),
    ("exploration", segments.rfm_exploration, EXPLORATION),
    ("rules", segments.rfm_rules, RULES),
    ("dashboard", segments.rfm_dashboard, DASHBOARD),
):
    add(f"rfm_{name}_table", RFM_COLUMNS, build, f"{sql} {TABLE}")
    add(f"rfm_{name}_segment_counts", RFM_COLUMNS,
        lambda sales, b=build: segments.segment_counts(b(sales)), f"{sql} {COUNTS}")
add("rfm_report_segment_summary", RFM_COLUMNS,
    lambda sales: segments.segment_summary(segments.rfm_report(sales)), f"""
{REPORT} SELECT segment, round_even({MEAN('recency')}, 1) AS recency_mean,
  round_even({MEAN('frequency')}, 1) AS frequency_mean,
  round_even({MEAN('monetary')}, 1) AS monetary_mean, count(monetary) AS customers
FROM segmented GROUP BY segment""")  # fmt: skip
add("rfm_dashboard_top20", RFM_COLUMNS,
    lambda sales: segments.best_customers(segments.rfm_dashboard(sales)), f"""
{DASHBOARD} {TABLE} ORDER BY segmented.monetary DESC, segmented.customer_id LIMIT 20""")  # fmt: skip

# ---- Dashboard -----------------------------------------------------------------------------------------
KPI = f"""SELECT count(*) AS orders, CAST(coalesce(sum(final_amount), 0) AS DOUBLE) AS revenue,
  {R(f"coalesce({DIV('sum(final_amount)', 'count(*)')}, 0)")} AS average_order_value FROM sales"""
add("kpis_all", "final_amount", dashboard.kpis, KPI)
add("kpis_by_amounts", "discounted_price",
    lambda sales: dashboard.kpis(
        sales.withColumnRenamed("discounted_price", "final_amount"), value_over="amounts"), f"""
SELECT count(*) AS orders, {D('sum(discounted_price)')} AS revenue,
  {R(f"coalesce({DIV('sum(discounted_price)', 'count(discounted_price)')}, 0)")}
    AS average_order_value FROM sales""")
add("kpis_date_range", "order_date order_year final_amount",
    partial(dashboard.kpis, start="1996-02-10", end="1998-11-30"),
    KPI + " WHERE order_date BETWEEN DATE '1996-02-10' AND DATE '1998-11-30'")
add("kpis_empty_range", "order_date order_year final_amount",
    partial(dashboard.kpis, start="2031-01-01", end="2031-12-31"),
    KPI + " WHERE order_date BETWEEN DATE '2031-01-01' AND DATE '2031-12-31'")


def resample_sql(unit: str, source: str, columns: str = "revenue, orders") -> str:
    return f"""WITH t AS (SELECT CAST(date_trunc('{unit}', order_date) AS DATE) AS p,
        sum(final_amount) AS r, count(*) AS n FROM {source} GROUP BY 1),
      s AS (SELECT CAST(unnest(generate_series(min(p), max(p), INTERVAL 1 {unit})) AS DATE) AS p
            FROM t),
      f AS (SELECT CAST(p + INTERVAL 1 {unit} - INTERVAL 1 DAY AS DATE) AS period_end,
        CAST(coalesce(r, 0) AS DOUBLE) AS revenue, coalesce(n, 0) AS orders
        FROM s LEFT JOIN t USING (p))
      SELECT period_end, {columns} FROM f"""


SPARSE = "is_festival_sale order_date final_amount"
for code, unit in (("M", "month"), ("Q", "quarter"), ("Y", "year")):
    add(f"trend_by_{unit}", "order_date final_amount", partial(dashboard.trend, period=code),
        resample_sql(unit, "sales"))
# Festival sales exist in three months of a year: the months between must appear with 0.
add("trend_with_empty_months", SPARSE,
    lambda sales: dashboard.trend(sales.where("is_festival_sale"), "M"),
    resample_sql("month", "(SELECT * FROM sales WHERE is_festival_sale)"))
add("top_products", "product_title final_amount", dashboard.top_products, f"""
SELECT product_title, {REV} FROM sales GROUP BY 1
ORDER BY sum(final_amount) DESC, product_title LIMIT 10""")  # fmt: skip
add("product_table", "product_title transaction_id final_amount", dashboard.product_table, f"""
SELECT product_title, count(DISTINCT transaction_id) AS orders, {REV},
  {R(MEAN('final_amount'))} AS average_price
FROM sales GROUP BY 1 ORDER BY sum(final_amount) DESC, product_title LIMIT 15""")  # fmt: skip
ONE = "(SELECT * FROM sales WHERE product_title = 'red widget')"
add("one_product_totals", "product_title transaction_id final_amount quantity",
    partial(dashboard.product_totals, name="red widget"), f"""
SELECT {REV}, count(DISTINCT transaction_id) AS orders, {QTY} FROM {ONE}""")  # fmt: skip
add("one_product_trend", "product_title order_date final_amount",
    partial(dashboard.product_trend, name="red widget"),
    resample_sql("month", ONE, "revenue"))
add("one_product_price_summary", "product_title final_amount",
    partial(dashboard.product_price_summary, name="red widget"),
    DESCRIBE(f"(SELECT CAST(final_amount AS DOUBLE) AS p FROM {ONE})", "p"))
add("one_product_price_histogram", "product_title final_amount",
    partial(dashboard.product_price_histogram, name="red widget"),
    HIST(ONE, "final_amount", 40))
# Prices as currency text: the sign and the thousands commas have to go first.
add("price_and_revenue", "product_title order_date original_price final_amount",
    lambda sales: dashboard.price_and_revenue(
        sales.withColumn("shown", F.concat(F.lit("₹"), F.format_number("original_price", 2))),
        "shown"), f"""
SELECT product_title, {R(MEAN('CAST(original_price AS DOUBLE)'), 4)} AS average_price, {REV},
  count(order_date) AS orders
FROM sales GROUP BY 1 ORDER BY sum(final_amount) DESC, product_title LIMIT 200""",
    digits={"average_price": 4})
add("top_customers", "customer_id final_amount", customers.top_customers, f"""
SELECT {I('customer_id')} AS customer_id, CAST(sum(final_amount) AS DOUBLE) AS total_revenue
FROM sales GROUP BY customer_id ORDER BY sum(final_amount) DESC, customer_id LIMIT 10""")  # fmt: skip
add("lifetime_top20", "customer_id final_amount",
    partial(customers.top_customers, n=20), f"""
SELECT {I('customer_id')} AS customer_id, CAST(sum(final_amount) AS DOUBLE) AS total_revenue
FROM sales GROUP BY customer_id ORDER BY sum(final_amount) DESC, customer_id LIMIT 20""")  # fmt: skip
add("order_frequency_histogram", "customer_id transaction_id",
    customers.order_frequency_histogram,
    HIST("(SELECT customer_id, count(DISTINCT transaction_id) AS n FROM sales GROUP BY 1)",
         "n", 40))

# Delivery times as text in six spellings, read by the dashboard's parser.


def delivery_texts(sales):
    spelling, days = F.col("product_id") % 6, F.col("delivery_days").cast("string")
    text = (
        F.when(spelling == 0, F.concat(days, F.lit(" days")))
        .when(spelling == 1, F.concat(days, F.lit("-"), (F.col("delivery_days") + 3).cast("string")))
        .when(spelling == 2, F.lit(" Same Day Delivery"))
        .when(spelling == 3, F.lit("Express"))
        .when(spelling == 4, F.concat(F.lit("-"), days))
        .otherwise(F.lit("soon"))
    )
    return sales.withColumn("delivery_text", text)


SPELLED = """d AS (SELECT *, CASE product_id % 6 WHEN 0 THEN CAST(delivery_days AS DOUBLE)
    WHEN 1 THEN delivery_days + 1.5 WHEN 2 THEN 0.0 WHEN 3 THEN 0.5 END AS parsed_days,
    CASE product_id % 6 WHEN 0 THEN delivery_days || ' days'
      WHEN 1 THEN delivery_days || '-' || (delivery_days + 3) WHEN 2 THEN ' Same Day Delivery'
      WHEN 3 THEN 'Express' WHEN 4 THEN '-' || delivery_days ELSE 'soon' END AS delivery_text
  FROM sales)"""
DELIVERY = "product_id delivery_days"
add("delivery_coverage", DELIVERY,
    lambda sales: dashboard.delivery_coverage(delivery_texts(sales)), f"""
WITH {SPELLED} SELECT count(*) AS "rows", count(parsed_days) AS parsed,
  count(*) FILTER (parsed_days <= 1) AS within_1, count(*) FILTER (parsed_days <= 2) AS within_2,
  count(*) FILTER (parsed_days <= 3) AS within_3 FROM d""")  # fmt: skip
add("delivery_summary", DELIVERY,
    lambda sales: dashboard.delivery_summary(delivery_texts(sales)),
    f"WITH {SPELLED} {DESCRIBE('d', 'parsed_days')}")
add("delivery_histogram", DELIVERY,
    lambda sales: dashboard.delivery_histogram(delivery_texts(sales)),
    f"WITH {SPELLED}, " + HIST("d", "parsed_days", 30)[5:])
TIES = ("order_date", "transaction_id", "l_linenumber", "l_suppkey", "product_id", "final_amount")
add("slowest_deliveries", f"{DELIVERY} order_date transaction_id l_linenumber l_suppkey final_amount",
    lambda sales: dashboard.slowest_deliveries(delivery_texts(sales), *TIES).select(
        "order_date", "transaction_id", "delivery_text", "parsed_days", "final_amount"), f"""
WITH {SPELLED} SELECT order_date, transaction_id, delivery_text, {R('parsed_days')} AS parsed_days,
  CAST(d.final_amount AS DOUBLE) AS final_amount FROM d WHERE parsed_days IS NOT NULL
ORDER BY d.parsed_days DESC, order_date, transaction_id, l_linenumber, l_suppkey, product_id,
  d.final_amount LIMIT 200""")  # fmt: skip
# Statuses with some missing, which count as 'unknown'.
add("status_counts", "return_status l_suppkey",
    lambda sales: dashboard.status_counts(sales.withColumn(
        "return_status", F.when(F.col("l_suppkey") % 5 != 0, F.col("return_status")))), """
SELECT coalesce(CASE WHEN l_suppkey % 5 <> 0 THEN return_status END, 'unknown') AS return_status,
  count(*) AS count FROM sales GROUP BY 1""")  # fmt: skip

# ---- Building blocks on their own ---------------------------------------------------------------------------
add("profile_columns", "customer_rating discounted_price festival_name customer_tier quantity",
    lambda sales: profile.profile(sales, distinct="exact").drop("type"),
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS "rows",
      count(*) - count({c}) AS missing, {R(f'CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100')}
        AS missing_percent, count(DISTINCT {c}) AS distinct_values FROM sales"""
      for c in ("customer_rating", "discounted_price", "festival_name", "customer_tier",
                "quantity")))
add("distinct_payment_methods", "payment_method",
    lambda sales: profile.distinct_values(sales, "payment_method"),
    "SELECT DISTINCT payment_method FROM sales")
add("value_counts_festival", "festival_name",
    lambda sales: frames.value_counts(sales, "festival_name"), """
SELECT festival_name, count(*) AS count FROM sales WHERE festival_name IS NOT NULL
GROUP BY 1""")  # fmt: skip
add("value_counts_festival_with_missing", "festival_name",
    lambda sales: frames.value_counts(sales, "festival_name", missing="none"), """
SELECT coalesce(festival_name, 'none') AS festival_name, count(*) AS count
FROM sales GROUP BY 1""")  # fmt: skip
add("describe_price_by_category", "category original_price",
    lambda sales: quantiles.describe(sales, "original_price", ["category"]),
    DESCRIBE("sales", "original_price").replace("SELECT", "SELECT category,", 1)
    + " GROUP BY category")
add("calendar_columns", "order_date final_amount",
    lambda sales: sales.select("final_amount", *[
        column.alias(name) for name, column in
        dates.calendar_columns(F.col("order_date")).items()]
    ).groupBy("order_year", "order_quarter", "order_month").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("final_amount").alias("revenue")), f"""
SELECT {I('year(order_date)')} AS order_year, {I('quarter(order_date)')} AS order_quarter,
  {I('month(order_date)')} AS order_month, count(*) AS "rows", {REV}
FROM sales GROUP BY year(order_date), quarter(order_date), month(order_date)""")  # fmt: skip
add("distinct_customer_categories", "customer_id subcategory",
    lambda sales: frames.distinct_rows(sales).groupBy("subcategory").agg(
        F.count(F.lit(1)).alias("customers")), """
SELECT subcategory, count(*) AS customers
FROM (SELECT DISTINCT customer_id, subcategory FROM sales) GROUP BY 1""")  # fmt: skip
add("union_of_years", "order_year transaction_id final_amount",
    lambda sales: sales.where("order_year < 1997").unionByName(
        sales.where("order_year >= 1997")).groupBy("order_year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("final_amount").alias("revenue")), f"""
SELECT {I('order_year')} AS order_year, count(*) AS "rows", {REV} FROM sales
GROUP BY order_year""")  # fmt: skip
add("loyal_customer_revenue", "customer_id customer_tier final_amount",
    lambda sales: sales.join(
        sales.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 40"),
        "customer_id", "left_semi").groupBy("customer_tier").agg(
        F.sum("final_amount").alias("revenue")), f"""
SELECT customer_tier, {REV} FROM sales WHERE customer_id IN
  (SELECT customer_id FROM sales GROUP BY 1 HAVING count(*) >= 40) GROUP BY 1""")  # fmt: skip
add("rolling_mean_monthly_quantity", "brand order_date quantity",
    lambda sales: sequences.rolling_mean(
        sales.groupBy("brand", F.trunc("order_date", "month").alias("month")).agg(
            F.sum("quantity").alias("quantity")), ["brand"], "month", "quantity", 3), f"""
WITH m AS (SELECT brand, CAST(date_trunc('month', order_date) AS DATE) AS month,
  sum(quantity) AS q FROM sales GROUP BY ALL)
SELECT brand, month, {I('q')} AS quantity,
  {R('CAST(sum(q) OVER w AS DOUBLE) / count(q) OVER w')} AS rolling
FROM m WINDOW w AS (PARTITION BY brand ORDER BY month
  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")  # fmt: skip
add("first_last_category", "customer_id subcategory " + " ".join(star.ROW_ORDER),
    lambda sales: sequences.first_and_last(sales, "customer_id", star.ROW_ORDER, "subcategory"), f"""
WITH n AS (SELECT customer_id, subcategory,
    row_number() OVER (PARTITION BY customer_id ORDER BY {', '.join(star.ROW_ORDER)}) AS k,
    count(*) OVER (PARTITION BY customer_id) AS c FROM sales)
SELECT {I('customer_id')} AS customer_id, {I('max(c)')} AS "rows",
  max(CASE WHEN k = 1 THEN subcategory END) AS first_subcategory,
  max(CASE WHEN k = c THEN subcategory END) AS last_subcategory
FROM n GROUP BY customer_id""")  # fmt: skip
add("qcut_price_by_value", "product_id original_price",
    lambda sales: qcut.qcut(
        sales.groupBy("product_id").agg(F.sum("original_price").alias("amount")),
        quarter=qcut.Cut("amount", bins=4)).groupBy("quarter").agg(
        F.count(F.lit(1)).alias("products"), F.max("amount").alias("highest")), """
WITH p AS (SELECT product_id, sum(original_price) AS amount FROM sales GROUP BY 1),
  q AS (SELECT amount, CASE WHEN CAST(amount AS DOUBLE) <= (SELECT quantile_cont(CAST(amount AS
    DOUBLE), 0.25) FROM p) THEN 1 WHEN CAST(amount AS DOUBLE) <= (SELECT quantile_cont(CAST(amount
    AS DOUBLE), 0.5) FROM p) THEN 2 WHEN CAST(amount AS DOUBLE) <= (SELECT quantile_cont(CAST(
    amount AS DOUBLE), 0.75) FROM p) THEN 3 ELSE 4 END AS quarter FROM p)
SELECT CAST(quarter AS BIGINT) AS quarter, count(*) AS products,
  CAST(max(amount) AS DOUBLE) AS highest FROM q GROUP BY quarter""")  # fmt: skip
add("exact_quantiles_by_tier", "customer_tier final_amount",
    lambda sales: quantiles.exact_quantiles(
        sales, "final_amount", [0.01, 0.5, 0.99], ["customer_tier"]), f"""
SELECT customer_tier, count(*) AS "rows",
  {R('quantile_cont(CAST(final_amount AS DOUBLE), 0.01)')} AS q0,
  {R('quantile_cont(CAST(final_amount AS DOUBLE), 0.5)')} AS q1,
  {R('quantile_cont(CAST(final_amount AS DOUBLE), 0.99)')} AS q2
FROM sales GROUP BY customer_tier""")  # fmt: skip
add("amount_box_overall", "final_amount",
    lambda sales: quantiles.box_stats(sales, "final_amount"), BOX("sales", "final_amount", []))
add("amount_histogram_by_tier", "customer_tier final_amount",
    lambda sales: histogram.histogram(sales, "final_amount", 25, ["customer_tier"]),
    HIST("sales", "final_amount", 25, ["customer_tier"]))
