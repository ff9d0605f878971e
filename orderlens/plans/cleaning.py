"""Raw text to typed ``sales``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.dates import parse_date
from orderlens.functions.delivery import average_days, whole_days
from orderlens.functions.numeric import nan_to_null
from orderlens.functions.payment import standard_method
from orderlens.functions.text import (
    clean_category,
    clean_city,
    clean_flag,
    clean_price,
    clean_rating,
    flag_to_int,
    plain_amount,
)
from orderlens.operators.duplicates import classify_duplicates, repeated_hashes
from orderlens.operators.outliers import flag_price_outliers
from orderlens.operators.settle import stage

# ---- Fixed values: what a missing value becomes when the file is finished ---------------
FINAL_FILLS = {
    "customer_rating": -1.0,
    "payment_method": "Not define",
    "customer_age_group": "26-35",
    "delivery_charges": 0,
    "duplicate_type": "normal",
}
# Filled even for analysis: these do not distort averages of what was observed.
ANALYSIS_FILLS = ("customer_age_group", "delivery_charges", "duplicate_type")
# ------------------------------------------------------------------------------------------

MONEY = "decimal(18,2)"


def type_columns(
    raw: DataFrame,
    delivery: str = "whole",
    day_first: bool = True,
    date_formats: Sequence[str] = (),
    also: Sequence[str] = (),
) -> DataFrame:
    """Cleaning rules column by column: no shuffle, all inside generated code.

    ``delivery`` picks the reading of the delivery text: 'whole' or 'average';
    ``day_first`` and ``date_formats`` are those of ``parse_date``. Only the list
    price is free text with a currency; the other amounts are plain numbers, with
    signs and exponents, and what is no number becomes NULL.
    """
    read_days = {"whole": whole_days, "average": average_days}[delivery]
    date = parse_date(F.col("order_date"), day_first, date_formats)
    present = set(raw.columns)

    def optional(name: str, target: str, rule) -> list:
        return [rule(F.col(name)).alias(target)] if name in present else []

    def same(name: str) -> list:
        return optional(name, name, lambda column: column)

    return raw.select(
        "transaction_id",
        "customer_id",
        "product_id",
        date.alias("order_date"),
        F.year(date).alias("order_year"),
        F.month(date).alias("order_month"),
        clean_category(F.col("category")).alias("category"),
        *same("subcategory"),
        *same("brand"),
        *optional("product_name", "product_title", lambda column: column),
        clean_price(F.col("original_price_inr")).alias("original_price"),
        *optional("discount_percent", "discount_percent", lambda c: nan_to_null(c.try_cast("double"))),
        *optional("discounted_price_inr", "discounted_price", plain_amount),
        *optional("quantity", "quantity", _whole),
        *optional("subtotal_inr", "subtotal", plain_amount),
        *optional("delivery_charges", "delivery_charges", plain_amount),
        plain_amount(F.col("final_amount_inr")).alias("final_amount"),
        *optional("customer_city", "customer_city", clean_city),
        *same("customer_state"),
        *same("customer_tier"),
        *same("customer_age_group"),
        *optional("is_prime_member", "is_prime_member", clean_flag),
        *optional("is_prime_eligible", "is_prime_eligible", clean_flag),
        *optional("is_festival_sale", "is_festival_sale", clean_flag),
        *same("festival_name"),
        *optional("payment_method", "payment_method", standard_method),
        *optional("delivery_days", "delivery_days", read_days),
        *optional("customer_rating", "customer_rating", clean_rating),
        *optional("product_rating", "product_rating", clean_rating),
        *same("return_status"),
        *also,
    )


def _whole(text: Column) -> Column:
    return text.try_cast("double").try_cast("int")


# Raw column -> typed column, for counting what could not be read.
READ_FROM = {
    "order_date": "order_date",
    "original_price_inr": "original_price",
    "discount_percent": "discount_percent",
    "discounted_price_inr": "discounted_price",
    "quantity": "quantity",
    "subtotal_inr": "subtotal",
    "delivery_charges": "delivery_charges",
    "final_amount_inr": "final_amount",
    "is_prime_member": "is_prime_member",
    "is_prime_eligible": "is_prime_eligible",
    "is_festival_sale": "is_festival_sale",
    "payment_method": "payment_method",
    "delivery_days": "delivery_days",
    "customer_rating": "customer_rating",
    "product_rating": "product_rating",
}


def unreadable_counts(raw: DataFrame, **options) -> DataFrame:
    """Per column: how many values are there and how many of them the rules turn into NULL.

    ``options`` are those of ``type_columns``. One pass, one row per column.
    """
    pairs = [(old, new) for old, new in READ_FROM.items() if old in raw.columns]
    kept = raw.withColumns({f"_raw_{old}": F.col(old) for old, _ in pairs})
    typed = type_columns(kept, **options, also=[f"_raw_{old}" for old, _ in pairs])
    counted = typed.agg(
        *[F.count(f"_raw_{old}").alias(f"n{i}") for i, (old, _) in enumerate(pairs)],
        *[
            F.count_if(F.col(f"_raw_{old}").isNotNull() & F.col(new).isNull()).alias(f"u{i}")
            for i, (old, new) in enumerate(pairs)
        ],
    )
    rows = [
        F.struct(F.lit(old).alias("column"), F.col(f"n{i}").alias("present"), F.col(f"u{i}").alias("unreadable"))
        for i, (old, _) in enumerate(pairs)
    ]
    return counted.select(F.inline(F.array(*rows)))


def fill_missing(df: DataFrame, final: bool = False) -> DataFrame:
    """Fills safe for analysis, or (``final``) all fills of the finished file.

    The finished file marks missing ratings with -1, which must not enter averages.
    """
    names = FINAL_FILLS if final else ANALYSIS_FILLS
    fills = {name: FINAL_FILLS[name] for name in names if name in df.columns}
    return df.fillna(fills)


def clean_sales(
    raw: DataFrame,
    final: bool = False,
    delivery: str = "whole",
    staging: str | None = None,
    day_first: bool = True,
    date_formats: Sequence[str] = (),
) -> DataFrame:
    """Typed columns, both price outlier flags, duplicate classes, fills.

    The typed rows are read several times (for the group statistics, then for the
    rows themselves), so they are written once as Parquet to ``staging`` or the
    session's shared folder: the raw text is parsed a single time, and not shuffled.
    """
    parsed = type_columns(raw, delivery, day_first, date_formats)
    typed = stage(parsed, staging)
    # Repeated keys are looked for in the typed rows, not in the flagged ones, so that
    # neither statistic has to repeat the other's joins.
    marked = classify_duplicates(flag_price_outliers(typed), repeats=repeated_hashes(typed))
    return fill_missing(marked, final)


def clean_catalogue(products: DataFrame) -> DataFrame:
    """Product list with the membership flag as 1/0."""
    return products.withColumn("is_prime_eligible", flag_to_int(F.col("is_prime_eligible")))


def quality_counts(cleaned: DataFrame) -> DataFrame:
    """How many rows each check marked."""
    return cleaned.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if(F.col("duplicate_type") == "bulk_order").alias("bulk_orders"),
        F.count_if(F.col("duplicate_type") == "error_duplicate").alias("error_duplicates"),
        F.count_if("price_outlier_iqr").alias("iqr_outliers"),
        F.count_if("price_outlier_3_sigma").alias("sigma_outliers"),
    )
