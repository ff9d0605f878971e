"""The rules on missing values, zero division, ties and rounding that every operator obeys."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderlens.functions import numeric, text
from orderlens.operators import frames, quantiles, statistics
from orderlens.plans import geography, revenue


def test_groups_with_a_missing_key_are_dropped(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2)], "k string, final_amount int")
    assert revenue.revenue_by(rows, "k").collect() == [("a", 1)]


def test_sum_of_nothing_is_zero(spark):
    rows = spark.createDataFrame([("a", None)], "k string, v int")
    assert rows.groupBy("k").agg(numeric.total("v")).first()[1] == 0


def test_nan_is_missing(spark):
    rows = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert [r[0] for r in rows.select(numeric.nan_to_null(F.col("v"))).collect()] == [None, 1.0]


def test_division_by_zero_is_missing(spark):
    row = spark.range(1).select(
        numeric.ratio(F.lit(1), F.lit(0)).alias("a"), numeric.ratio(F.lit(0), F.lit(0)).alias("b")
    )
    assert row.first() == (None, None)


def test_growth_from_zero_is_missing(spark):
    rows = spark.createDataFrame([(1, 0), (2, 5), (3, 10)], "y int, v int")
    grown = rows.select("y", numeric.percent_change(F.col("v"), Window.orderBy("y")).alias("g"))
    assert [r.g for r in grown.orderBy("y").collect()] == [None, None, 100.0]


def test_quantiles_interpolate(spark):
    rows = spark.createDataFrame([(10,), (20,), (25,)], "v int")
    assert quantiles.exact_quantiles(rows, "v", [0.25]).first() == (3, 15.0)


def test_rounding_is_half_even(spark):
    row = spark.sql("SELECT 2.5D AS a, 3.5D AS b")
    assert row.select(numeric.half_even(F.col("a")), numeric.half_even(F.col("b"))).first() == (2, 4)


def test_most_frequent_tier_prefers_the_first_of_equals(spark):
    rows = spark.createDataFrame(
        [("x", "b", 1), ("x", "a", 1), ("x", None, 1), ("x", None, 1), ("x", None, 1)],
        "customer_city string, customer_tier string, final_amount int",
    )
    assert geography.city_revenue(rows).first().asDict() == {
        "customer_city": "x", "revenue": 5, "customer_tier": "a",
    }


def test_peak_month_prefers_the_first_of_equals(spark):
    rows = spark.createDataFrame([(3, 7), (2, 7), (1, 1)], "order_month int, final_amount int")
    assert revenue.peak_month(rows).first().month_name == "Feb"


def test_title_case_starts_words_after_any_non_letter(spark):
    row = spark.createDataFrame([("o'neil & sons-2nd",)], "t string")
    assert row.select(text.title_case(F.col("t"))).first()[0] == "o'neil & sons-2nd".title()


def test_correlation_uses_complete_pairs_and_survives_constants(spark):
    data = [(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (3.0, None, 5.0), (None, 9.0, 5.0), (4.0, 4.0, 5.0)]
    found = {
        (r.a, r.b): r.r
        for r in statistics.correlation_matrix(
            spark.createDataFrame(data, "x double, y double, z double"), ["x", "y", "z"]
        ).collect()
    }
    expected = pd.DataFrame(data, columns=["x", "y", "z"], dtype=float).corr()
    assert found["x", "y"] == pytest.approx(expected.loc["x", "y"])
    assert found["x", "x"] == pytest.approx(1.0)
    assert found["x", "z"] is None and found["z", "z"] is None
    assert len(found) == 9


def test_single_row_has_no_deviation(spark):
    rows = spark.createDataFrame([(5.0,)], "v double")
    assert quantiles.describe(rows, "v").first().asDict() == {
        "count": 1, "mean": 5.0, "std": None, "min": 5.0, "q25": 5.0, "q50": 5.0, "q75": 5.0,
        "max": 5.0,
    }


def test_a_missing_condition_counts_as_not_met(spark):
    rows = spark.createDataFrame([("Returned",), (None,), ("x",), ("Returned",)], "s string")
    assert rows.agg(numeric.rate(F.col("s") == "Returned")).first()[0] == 0.5


def test_top_rows_break_ties_by_name(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "k string, v int")
    assert [r.k for r in frames.top_rows(rows, 2, "v", "k").collect()] == ["a", "b"]


def test_first_present_column(spark):
    rows = spark.createDataFrame([(1, 2)], "title int, product_name int")
    assert frames.first_present(rows, "product") == "product_name"
    assert frames.first_present(rows, "location") is None
    assert frames.first_present(rows, ("x", "title")) == "title"


def test_date_range_keeps_the_whole_last_day(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (timestamp'2020-01-01 00:00:00'), (timestamp'2020-01-31 23:59:59.9'), "
        "(timestamp'2020-02-01 00:00:00') AS t(at)"
    )
    assert frames.between_dates(rows, "2020-01-01", "2020-01-31", "at").count() == 2
