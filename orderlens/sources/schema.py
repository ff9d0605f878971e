"""The column contract: raw text at ingest, typed ``sales`` afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.numeric import nan_to_null

# ---- Fixed values: column names of the raw files --------------------------------------
RAW_COLUMNS = (
    "transaction_id",
    "order_date",
    "customer_id",
    "product_id",
    "product_name",
    "category",
    "subcategory",
    "brand",
    "original_price_inr",
    "discount_percent",
    "discounted_price_inr",
    "quantity",
    "subtotal_inr",
    "delivery_charges",
    "final_amount_inr",
    "customer_city",
    "customer_state",
    "customer_tier",
    "customer_age_group",
    "is_prime_member",
    "is_prime_eligible",
    "is_festival_sale",
    "festival_name",
    "payment_method",
    "delivery_days",
    "customer_rating",
    "product_rating",
    "return_status",
)
# Texts a CSV uses for "no value".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Cleaned-file spelling of a column -> name used throughout the library.
CLEANED_NAMES = {
    "clean_order_date": "order_date",
    "cleaned_category": "category",
    "clean_original_price_inr": "original_price",
    "discounted_price_inr": "discounted_price",
    "clean_final_amount_inr": "final_amount",
    "clean_discount_percent": "discount_percent",
    "cleaned_customer_city": "customer_city",
    "cleaned_is_prime_member": "is_prime_member",
    "cleaned_is_festival_sale": "is_festival_sale",
    "standard_payment_method": "payment_method",
    "cleaned_delivery_days": "delivery_days",
    "cleaned_customer_rating": "customer_rating",
    "cleaned_product_rating": "product_rating",
    "product_name": "product_title",
}
# Typed columns of the ``sales`` table every analysis reads.
SALES_TYPES = {
    "transaction_id": "string",
    "customer_id": "string",
    "product_id": "string",
    "order_date": "date",
    "order_year": "int",
    "order_month": "int",
    "category": "string",
    "subcategory": "string",
    "brand": "string",
    "product_title": "string",
    "original_price": "decimal(18,2)",
    "discount_percent": "double",
    "discounted_price": "decimal(18,2)",
    "quantity": "int",
    "subtotal": "decimal(18,2)",
    "delivery_charges": "decimal(18,2)",
    "final_amount": "decimal(18,2)",
    "customer_city": "string",
    "customer_state": "string",
    "customer_tier": "string",
    "customer_age_group": "string",
    "is_prime_member": "boolean",
    "is_prime_eligible": "boolean",
    "is_festival_sale": "boolean",
    "festival_name": "string",
    "payment_method": "string",
    "delivery_days": "double",
    "customer_rating": "double",
    "product_rating": "double",
    "return_status": "string",
}
# ------------------------------------------------------------------------------------------

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])


def from_cleaned_names(df: DataFrame) -> DataFrame:
    """Rename and type an already cleaned file to the ``sales`` contract.

    Where both spellings exist (raw and cleaned), the cleaned one wins.
    """
    present = set(df.columns)
    replaced = {new for old, new in CLEANED_NAMES.items() if old in present}
    chosen = []
    for name in df.columns:
        target = CLEANED_NAMES.get(name, name)
        if name in CLEANED_NAMES or name not in replaced:
            kind = SALES_TYPES.get(target)
            column = F.col(name)
            chosen.append((column.try_cast(kind) if kind else column).alias(target))
    return without_nan(df.select(*chosen))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN in double columns means "missing": it would spoil means and compare as the largest."""
    return df.select(
        *[
            nan_to_null(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def dashboard_view(sales: DataFrame) -> DataFrame:
    """``sales`` plus the two names dashboards look for."""
    return sales.withColumn("order_datetime", F.col("order_date").cast("timestamp")).withColumn(
        "revenue", F.col("final_amount")
    )
