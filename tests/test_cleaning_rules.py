"""Every branch of the cleaning rules on literal values."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orderlens.functions import bins, dates, delivery, payment, text

DAY = datetime.date(2015, 1, 25)
CASES = {
    "date": (
        lambda c: dates.parse_date(c),
        {
            "2015-01-25": DAY, "25/01/2015": DAY, "25-01-2015": DAY, "2015-1-25": DAY,
            "2015-01-25 10:11:12": DAY, "n/a": None, "31/02/2015": None, None: None,
        },
    ),
    "price": (
        lambda c: text.clean_price(c),
        {
            "₹1,25,000.50": Decimal("125000.50"), "Rs 999": Decimal("999.00"),
            "1.005": Decimal("1.00"), "1.015": Decimal("1.02"), "Price on Request": None, None: None,
        },
    ),
    "plain price": (
        text.plain_price,
        {"₹1,250.5": 1250.5, "999": 999.0, "Rs 999": None, None: None},
    ),
    "rating": (
        text.clean_rating,
        {"4.5/5": 4.5, "3 stars": 3.0, "5": 5.0, "good": None, "4.5.1": None, None: None},
    ),
    "city": (
        text.clean_city,
        {
            " Bombay ": "Mumbai", "mumba": "Mumbai", "banglore": "Bengaluru",
            "bengalore": "Bengaluru", "Calcutta": "Kolkata", "MADRAS": "Chennai",
            "delhi ncr": "Delhi", "new delhi": "Delhi", "pune": "Pune", "delhi-x": "Delhi-X",
            "navi mumbai": "Navi Mumbai", None: None,
        },
    ),
    "category": (
        text.clean_category,
        {
            "ELECTRONICSS": "Electronics", " electronic ": "Electronics",
            "electronics & accessories": "Electronics & Accessories", "home decor": "Home Decor",
            None: None,
        },
    ),
    "flag": (
        text.clean_flag,
        {
            "Yes": True, "1": True, " TRUE ": True, "y": True, "n": False, "0": False,
            "False": False, "NO": False, "maybe": None, None: None,
        },
    ),
    "whole days": (
        delivery.whole_days,
        {
            "Same Day": 0.0, "express": 0.0, "1-2 days": 2.0, "2-3": 2.0, "3-4": 4.0, "-1": 1.0,
            "45": None, "30": 30.0, "5 days": 5.0, "soon": None, None: None,
        },
    ),
    "average days": (
        delivery.average_days,
        {
            "same day delivery": 0.0, "Express": 0.5, "-1": None, "1-2 days": 1.5, "1.5": 3.0,
            "7": 7.0, "soon": None, "": None, "nan": None, None: None,
        },
    ),
    "standard payment": (
        payment.standard_method,
        {
            "C.O.D": "COD", "Cash on Delivery": "COD", "PhonePe": "UPI", "CC": "Credit Card",
            "DEBIT_CARD": "Debit Card", "NetBanking": "Net Banking", "Mobikwik": "Wallet",
            "Buy Now Pay Later": "BNPL", "Cheque": None, None: None,
        },
    ),
    "focus payment": (
        payment.focus_method,
        {"UPI": "UPI", "COD": "COD", "Wallet": "Other", None: "Other"},
    ),
    "wallet payment": (
        payment.wallet_method,
        {"upi": "UPI", "Cod": "COD", "Wallet": "Digital Wallet", "BNPL": "Other", None: "Other"},
    ),
    "missing label": (
        lambda c: text.label_missing(c, "Unknown"),
        {"a": "a", None: "Unknown"},
    ),
}


@pytest.mark.parametrize("rule", CASES)
def test_rule(spark, rule):
    build, expected = CASES[rule]
    rows = spark.createDataFrame([(given,) for given in expected], "given string")
    found = {row.given: row.cleaned for row in rows.select("given", build(F.col("given")).alias("cleaned")).collect()}
    assert found == expected


def test_discount_bins_are_open_on_the_right(spark):
    expected = {0: "0-10%", 9: "0-10%", 10: "10-20%", 50: "50%+", 99: "50%+", 100: None, -1: None}
    rows = spark.createDataFrame([(p,) for p in expected], "p int")
    found = {r.p: r.b for r in rows.select("p", bins.discount_bin(F.col("p")).alias("b")).collect()}
    assert found == expected


def test_price_bin_leaves_out_the_highest_price(spark):
    rows = spark.createDataFrame([(499.0,), (10000.0,), (20000.0,)], "p double")
    binned = rows.select(bins.price_bin(F.col("p"), F.lit(20000)).alias("b"))
    assert [r.b for r in binned.collect()] == ["0-500", "10000+", None]


def test_flag_as_number(spark):
    rows = spark.createDataFrame([("True",), ("no",), ("?",)], "f string")
    assert [r[0] for r in rows.select(text.flag_to_int(F.col("f"))).collect()] == [1, 0, None]


def test_months_ignore_the_day(spark):
    row = spark.sql("SELECT date'2020-03-01' AS later, date'2020-01-31' AS earlier")
    months = dates.calendar_months_between(F.col("later"), F.col("earlier"))
    assert row.select(months).first()[0] == 2


def test_amounts_keep_their_sign_and_bad_values_are_counted(spark):
    from orderlens.plans import cleaning

    raw = spark.createDataFrame(
        [("1", "05 Mar 2020", "₹1,200", "-90.5", "Infinity"), ("2", "2020-03-05", None, "1e3", "2.0"),
         ("3", None, "x", " ", "nan"), ("4", "1/2/2020", "5", "1e30", None)],
        "transaction_id string, order_date string, original_price_inr string, "
        "final_amount_inr string, quantity string",
    ).selectExpr("*", "'c' customer_id", "'p' product_id", "'Books' category")
    rows = cleaning.type_columns(raw, date_formats=["dd MMM yyyy"], day_first=False).collect()
    assert [None if r.final_amount is None else float(r.final_amount) for r in rows] == [-90.5, 1000.0, None, None]
    assert [r.quantity for r in rows] == [None, 2, None, None]
    assert [str(r.order_date) for r in rows] == ["2020-03-05", "2020-03-05", "None", "2020-01-02"]
    bad = {r["column"]: (r.present, r.unreadable) for r in cleaning.unreadable_counts(raw).collect()}
    assert bad["order_date"] == (3, 1) and bad["final_amount_inr"] == (4, 2)
    assert bad["original_price_inr"] == (3, 1) and bad["quantity"] == (3, 2)
