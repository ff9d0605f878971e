"""The ``sales`` table derived from an order/line-item star schema.

Only the tables that the requested columns need are joined. Region and nation
have a fixed number of rows by definition of the schema and are broadcast; how
the growing tables meet is left to the optimizer, which measures their sizes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values: how the star schema's codes read as retail terms ------------------
TIERS = ((7000, "Metro"), (4000, "Tier 1"), (1000, "Tier 2"))
LOWEST_TIER = "Rural"
AGE_GROUPS = {
    "AUTOMOBILE": "18-25",
    "BUILDING": "26-35",
    "FURNITURE": "36-45",
    "HOUSEHOLD": "46-55",
    "MACHINERY": "55+",
}
PAYMENTS = {"1": "UPI", "2": "COD", "3": "Credit Card", "4": "Debit Card", "5": "Net Banking"}
FESTIVALS = {"01-26": "Republic Day", "08-15": "Independence Day", "11-01": "Diwali"}
RETURNS = {"R": "Returned", "A": "Cancelled", "N": "Delivered"}
# ------------------------------------------------------------------------------------------


def _labels(code: str, labels: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{key}' THEN '{label}'" for key, label in labels.items())
    return f"CASE {code} {whens} END"


_DATE = "cast(o_orderdate AS date)"
# Prices are binary doubles with two digits after the point. Whole cents and whole
# percents as bigint are exact and much cheaper than casting doubles to decimal.
_CENTS = "cast(l_extendedprice * 100 + 0.5D AS bigint)"
_PERCENT_PAID = "(100 - cast(l_discount * 100 + 0.5D AS bigint))"
_ORIGINAL = f"cast(cast({_CENTS} AS decimal(18,0)) * 0.01BD AS decimal(18,2))"
_PAID = f"cast(cast({_CENTS} * {_PERCENT_PAID} AS decimal(20,0)) * 0.0001BD AS decimal(24,4))"
_FESTIVAL = _labels(f"date_format({_DATE}, 'MM-dd')", FESTIVALS)
_TIER_STEPS = " ".join(f"WHEN c_acctbal >= {floor} THEN '{label}'" for floor, label in TIERS)

_LINE = frozenset()
_ORDERS, _PART = frozenset({"orders"}), frozenset({"part"})
_CUSTOMER = _ORDERS | {"customer"}
_NATION = _CUSTOMER | {"nation"}
_REGION = _NATION | {"region"}

# Column name -> (tables needed beyond lineitem, SQL expression).
DEFINITIONS: dict[str, tuple[frozenset[str], str]] = {
    "transaction_id": (_LINE, "cast(l_orderkey AS string)"),
    "customer_id": (_ORDERS, "o_custkey"),
    "product_id": (_LINE, "l_partkey"),
    "l_linenumber": (_LINE, "l_linenumber"),
    "l_suppkey": (_LINE, "l_suppkey"),
    "order_date": (_ORDERS, _DATE),
    "order_year": (_ORDERS, f"year({_DATE})"),
    "order_month": (_ORDERS, f"month({_DATE})"),
    "category": (_PART, "p_type"),
    "subcategory": (_PART, "split_part(p_name, ' ', 2)"),
    "brand": (_PART, "p_brand"),
    "product_title": (_PART, "p_name"),
    "customer_city": (_NATION, "n_name"),
    "customer_state": (_REGION, "r_name"),
    "customer_tier": (_CUSTOMER, f"CASE {_TIER_STEPS} ELSE '{LOWEST_TIER}' END"),
    "customer_age_group": (_CUSTOMER, _labels("c_mktsegment", AGE_GROUPS)),
    "is_prime_member": (_ORDERS, "o_custkey % 3 = 0"),
    "festival_name": (_ORDERS, _FESTIVAL),
    "is_festival_sale": (_ORDERS, f"({_FESTIVAL}) IS NOT NULL"),
    "payment_method": (_ORDERS, _labels("substring(o_orderpriority, 1, 1)", PAYMENTS)),
    "delivery_days": (_ORDERS, f"abs(datediff(cast(l_shipdate AS date), {_DATE})) % 12"),
    "product_rating": (_PART, "CASE WHEN p_size % 10 <> 0 THEN cast(1 + p_size % 5 AS double) END"),
    "customer_rating": (
        _LINE,
        "CASE WHEN l_suppkey % 11 <> 0 "
        "THEN cast(1 + (l_linenumber + l_suppkey) % 5 AS double) END",
    ),
    "return_status": (_LINE, _labels("l_returnflag", RETURNS)),
    "quantity": (_LINE, "cast(l_quantity AS int)"),
    "discount_percent": (_LINE, "cast(l_discount * 100 + 0.5D AS int) * 5"),
    "original_price": (_LINE, _ORIGINAL),
    "discounted_price": (_LINE, f"CASE WHEN l_suppkey % 7 <> 0 THEN {_PAID} END"),
    "final_amount": (_LINE, _PAID),
}

# Total order of a customer's rows: date, order, line, then whatever still differs.
ROW_ORDER = (
    "order_date", "transaction_id", "l_linenumber", "l_suppkey", "product_id", "quantity",
    "final_amount",
)


def sales(
    spark: SparkSession,
    folder: str,
    columns: Iterable[str] | None = None,
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """Order lines with the ``sales`` columns asked for (all by default).

    ``years`` (first, last) is stated on the stored order date, so that it reaches
    the scan of the orders and skips what lies outside.
    """
    wanted = list(dict.fromkeys(DEFINITIONS if columns is None else columns))
    tables = frozenset().union(*[DEFINITIONS[name][0] for name in wanted])

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    lines = table("lineitem")
    if "orders" in tables or years is not None:
        orders = table("orders")
        if years is not None:
            first, after = (F.lit(f"{year}-01-01").cast("timestamp") for year in (years[0], years[1] + 1))
            orders = orders.where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < after))
        if "customer" in tables:
            # There are far fewer orders than lines: lines are shuffled once for both.
            orders = orders.join(table("customer"), F.expr("o_custkey = c_custkey"))
        lines = lines.join(orders, F.expr("l_orderkey = o_orderkey"))
    if "part" in tables:
        # What a part's own columns say is worked out per part, not per line.
        own = [f"{DEFINITIONS[name][1]} AS {name}" for name in wanted if DEFINITIONS[name][0] == _PART]
        lines = lines.join(table("part").selectExpr("p_partkey", *own), F.expr("l_partkey = p_partkey"))
    if "nation" in tables:
        lines = lines.join(F.broadcast(table("nation")), F.expr("c_nationkey = n_nationkey"))
    if "region" in tables:
        lines = lines.join(F.broadcast(table("region")), F.expr("n_regionkey = r_regionkey"))
    return lines.selectExpr(
        *[name if DEFINITIONS[name][0] == _PART else f"{DEFINITIONS[name][1]} AS {name}" for name in wanted]
    )
