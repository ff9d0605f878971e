"""Registration of queries and the small vocabulary their SQL is written in."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.sources import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SALES_SQL = """sales AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS transaction_id, o_custkey AS customer_id,
    l_partkey AS product_id, l_linenumber, l_suppkey,
    CAST(o_orderdate AS DATE) AS order_date,
    CAST(year(o_orderdate) AS INTEGER) AS order_year,
    CAST(month(o_orderdate) AS INTEGER) AS order_month,
    p_type AS category, split_part(p_name, ' ', 2) AS subcategory, p_brand AS brand,
    p_name AS product_title, n_name AS customer_city, r_name AS customer_state,
    CASE WHEN c_acctbal >= 7000 THEN 'Metro' WHEN c_acctbal >= 4000 THEN 'Tier 1'
         WHEN c_acctbal >= 1000 THEN 'Tier 2' ELSE 'Rural' END AS customer_tier,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '18-25' WHEN 'BUILDING' THEN '26-35'
         WHEN 'FURNITURE' THEN '36-45' WHEN 'HOUSEHOLD' THEN '46-55'
         WHEN 'MACHINERY' THEN '55+' END AS customer_age_group,
    o_custkey % 3 = 0 AS is_prime_member,
    CASE strftime(o_orderdate, '%m-%d') WHEN '01-26' THEN 'Republic Day'
         WHEN '08-15' THEN 'Independence Day' WHEN '11-01' THEN 'Diwali' END AS festival_name,
    strftime(o_orderdate, '%m-%d') IN ('01-26', '08-15', '11-01') AS is_festival_sale,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'UPI' WHEN '2' THEN 'COD'
         WHEN '3' THEN 'Credit Card' WHEN '4' THEN 'Debit Card'
         WHEN '5' THEN 'Net Banking' END AS payment_method,
    abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 12
      AS delivery_days,
    CASE WHEN p_size % 10 <> 0 THEN CAST(1 + p_size % 5 AS DOUBLE) END AS product_rating,
    CASE WHEN l_suppkey % 11 <> 0 THEN CAST(1 + (l_linenumber + l_suppkey) % 5 AS DOUBLE) END
      AS customer_rating,
    CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Cancelled'
         WHEN 'N' THEN 'Delivered' END AS return_status,
    CAST(l_quantity AS INTEGER) AS quantity,
    CAST(round(l_discount * 100) AS INTEGER) * 5 AS discount_percent,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS original_price,
    CASE WHEN l_suppkey % 7 <> 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2))
         * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(24,4)) END AS discounted_price,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2))
         * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(24,4)) AS final_amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

DIGITS = 6
# Sums of squares depend on the order of addition further up.
FEWER_DIGITS = {"std": 4}


def plain(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Engine-neutral result types: bigint, double (rounded), text, boolean, date.

    Exact money sums only change their type; other doubles are rounded, because
    two engines may add in a different order.
    """
    chosen = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        places = (digits or FEWER_DIGITS).get(field.name, DIGITS)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), places)
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        chosen.append(column.alias(field.name))
    return df.select(*chosen)


def add(
    name: str,
    columns: str,
    build: Callable[[DataFrame], DataFrame],
    sql: str | None,
    digits: dict[str, int] | None = None,
) -> None:
    """Register ``build(sales)``; ``columns`` are the sales columns it reads."""
    wanted = columns.split()

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return plain(build(star.sales(spark, folder, wanted)), digits)

    add_tables(name, query, sql)


def add_tables(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = with_sales(sql)


def with_sales(sql: str) -> str:
    sql = sql.strip()
    if sql.startswith("WITH "):
        return f"WITH {SALES_SQL}, {sql[5:]}"
    return f"WITH {SALES_SQL} {sql}"


# ---- SQL vocabulary --------------------------------------------------------------------


def I(expr: str) -> str:  # noqa: E743
    return f"CAST({expr} AS BIGINT)"


def D(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def R(expr: str, digits: int = DIGITS) -> str:
    return f"round({D(expr)}, {digits})"


def DIV(top: str, bottom: str) -> str:
    return f"CASE WHEN ({bottom}) <> 0 THEN {D(top)} / {D(bottom)} END"


def MEAN(expr: str) -> str:
    return DIV(f"sum({expr})", f"count({expr})")


REV = f"{D('sum(final_amount)')} AS revenue"
QTY = f"{I('sum(quantity)')} AS quantity"
MONTH_NAME = "strftime(make_date(2000, order_month, 1), '%b')"


def _list(keys: Sequence[str]) -> str:
    return "".join(f"{key}, " for key in keys)


def _by(keys: Sequence[str]) -> str:
    return f" GROUP BY {', '.join(keys)}" if keys else ""


def _join(left: str, right: str, keys: Sequence[str]) -> str:
    return f"{left} JOIN {right} USING ({', '.join(keys)})" if keys else f"{left}, {right}"


def BOX(source: str, value: str, keys: Sequence[str]) -> str:
    """Box statistics of ``value`` in ``source`` (a FROM item)."""
    k = _list(keys)
    filled = " AND ".join([f"{value} IS NOT NULL", *[f"{key} IS NOT NULL" for key in keys]])
    inside = "v >= a - 1.5 * (c - a) AND v <= c + 1.5 * (c - a)"
    return f"""WITH x AS (SELECT {k}{D(value)} AS v FROM {source} WHERE {filled}),
      q AS (SELECT {k}quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b,
              quantile_cont(v, 0.75) AS c FROM x{_by(keys)})
      SELECT {k}count(*) AS "rows", {R('min(v)')} AS minimum,
        {R(f'min(CASE WHEN {inside} THEN v END)')} AS whisker_low, {R('max(a)')} AS q1,
        {R('max(b)')} AS median, {R('max(c)')} AS q3,
        {R(f'max(CASE WHEN {inside} THEN v END)')} AS whisker_high, {R('max(v)')} AS maximum,
        {I(f'sum(CASE WHEN {inside} THEN 0 ELSE 1 END)')} AS outliers
      FROM {_join('x', 'q', keys)}{_by(keys)}"""


def HIST(source: str, value: str, bins: int, keys: Sequence[str] = (), weight: str = "1") -> str:
    """Equal-width histogram with all bins listed."""
    k = _list(keys)
    filled = " AND ".join([f"{value} IS NOT NULL", *[f"{key} IS NOT NULL" for key in keys]])
    place = f"""CASE WHEN hi > lo THEN least({bins - 1}, floor((v - lo) * {bins} / (hi - lo)))
        ELSE 0 END"""
    return f"""WITH x AS (SELECT {k}{D(value)} AS v, {weight} AS w FROM {source} WHERE {filled}),
      b AS (SELECT {k}min(v) AS lo, max(v) AS hi FROM x{_by(keys)}),
      c AS (SELECT {k}{I(place)} AS bin, sum(w) AS n FROM {_join('x', 'b', keys)}
            GROUP BY ALL),
      s AS (SELECT {k}lo, hi, unnest(range({bins})) AS bin FROM b)
      SELECT {k}{I('bin')} AS bin, {R(f'lo + (hi - lo) / {bins} * bin')} AS bin_start,
        {R(f'lo + (hi - lo) / {bins} * (bin + 1)')} AS bin_end,
        {I('coalesce(n, 0)')} AS count
      FROM s LEFT JOIN c USING ({k}bin)"""


def DENSITY(
    source: str, value: str, points: int, keys: Sequence[str] = (), weight: str = "1",
    resolution: int = 512, digits: int = 5,
) -> str:
    """Gaussian density with Scott bandwidth from a fine histogram."""
    k = _list(keys)
    filled = " AND ".join([f"{value} IS NOT NULL", *[f"{key} IS NOT NULL" for key in keys]])
    n = resolution
    place = f"""CASE WHEN hi > lo THEN least({n - 1}, floor((v - lo) * {n} / (hi - lo)))
        ELSE 0 END"""
    return f"""WITH x AS (SELECT {k}{D(value)} AS v, {weight} AS w FROM {source} WHERE {filled}),
      b AS (SELECT {k}min(v) AS lo, max(v) AS hi FROM x{_by(keys)}),
      c AS (SELECT {k}lo, hi, {D('sum(w)')} AS n,
              lo + (hi - lo) / {n} * ({place} + 0.5) AS center
            FROM {_join('x', 'b', keys)} GROUP BY {k}lo, hi, {place}),
      h AS (SELECT {k}sum(n) AS total, max(lo) AS lo1, max(hi) AS hi1,
              sqrt((sum(n * (center - lo) * (center - lo))
                    - sum(n * (center - lo)) * sum(n * (center - lo)) / sum(n))
                   / (sum(n) - 1)) * pow(sum(n), CAST(-0.2 AS DOUBLE)) AS band
            FROM c{_by(keys)}),
      g AS (SELECT {k}unnest(range({points})) AS point, total, lo1, hi1, band FROM h
            WHERE band > 0)
      SELECT {k}{I('point')} AS point, {R(f'max(lo1 + (hi1 - lo1) * point / {points - 1})')} AS x,
        {R(f'''sum(n * exp(-0.5 * pow((lo1 + (hi1 - lo1) * point / {points - 1} - center)
            / band, 2))) / (max(total) * max(band) * sqrt(2 * pi()))''', digits)} AS density
      FROM {_join('g', 'c', keys)} GROUP BY {k}point"""


def CORR(source: str, columns: Sequence[str], where: str = "TRUE") -> str:
    """Long correlation matrix."""
    cells = ", ".join(
        f"{R(f'CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END')}"
        f' AS "{a}|{b}"'
        for a in columns
        for b in columns
    )
    rows = " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, "{a}|{b}" AS r FROM m""" for a in columns for b in columns
    )
    return f"WITH m AS (SELECT {cells} FROM {source} WHERE {where}) {rows}"


def DESCRIBE(source: str, value: str) -> str:
    v = D(value)
    return f"""SELECT count({value}) AS count, {R(MEAN(value))} AS mean,
        {R(f'stddev_samp({v})', 4)} AS std, {R(f'min({v})')} AS min,
        {R(f'quantile_cont({v}, 0.25)')} AS q25, {R(f'quantile_cont({v}, 0.5)')} AS q50,
        {R(f'quantile_cont({v}, 0.75)')} AS q75, {R(f'max({v})')} AS max
      FROM {source}"""
