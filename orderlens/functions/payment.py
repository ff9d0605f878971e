"""Three label sets for the payment method. They differ on purpose and are never merged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: spelling -> label ----------------------------------------------
STANDARD_LABELS = {
    "COD": "COD",
    "Cash on Delivery": "COD",
    "C.O.D": "COD",
    "UPI": "UPI",
    "PhonePe": "UPI",
    "GooglePay": "UPI",
    "UPI/PhonePe/GooglePay": "UPI",
    "Credit Card": "Credit Card",
    "CREDIT_CARD": "Credit Card",
    "CC": "Credit Card",
    "Debit Card": "Debit Card",
    "DEBIT_CARD": "Debit Card",
    "DC": "Debit Card",
    "Net Banking": "Net Banking",
    "NetBanking": "Net Banking",
    "Wallet": "Wallet",
    "Paytm Wallet": "Wallet",
    "Mobikwik": "Wallet",
    "BNPL": "BNPL",
    "Buy Now Pay Later": "BNPL",
}
WALLET_LABELS = {
    "UPI": "UPI",
    "upi": "UPI",
    "COD": "COD",
    "Cod": "COD",
    "Debit Card": "Debit Card",
    "Credit Card": "Credit Card",
    "Net Banking": "Net Banking",
    "Wallet": "Digital Wallet",
}
FOCUS_METHODS = ("UPI", "COD", "Debit Card", "Credit Card", "Net Banking")
OTHER = "Other"
# -------------------------------------------------------------------------------------


def _lookup(method: Column, labels: dict[str, str]) -> Column:
    pairs = [F.lit(part) for pair in labels.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), method)


def standard_method(method: Column) -> Column:
    """Seven standard labels; unknown spellings become NULL."""
    return _lookup(method, STANDARD_LABELS)


def focus_method(method: Column, focus: tuple[str, ...] = FOCUS_METHODS) -> Column:
    """Keep the methods under study, everything else (and missing) is 'Other'."""
    return F.when(method.isin(*focus), method).otherwise(OTHER)


def wallet_method(method: Column) -> Column:
    """Label set with 'Digital Wallet'; unmapped values are 'Other'."""
    return F.coalesce(_lookup(method, WALLET_LABELS), F.lit(OTHER))
