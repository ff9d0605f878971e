"""Payment methods over the years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import ratio, share
from orderlens.functions.payment import focus_method, wallet_method
from orderlens.operators.frames import between_years, complete_grid, with_keys

FIRST_YEAR, LAST_YEAR = 2015, 2025  # fixed values: period of the published report


def _yearly_counts(sales: DataFrame, label: Column, counted: Column) -> DataFrame:
    labelled = sales.select("order_year", label.alias("payment_method"), counted.alias("_c"))
    return (
        with_keys(labelled, "order_year", "payment_method")
        .groupBy("order_year", "payment_method")
        .agg(F.count("_c").alias("transactions"))
    )


def payment_share(
    sales: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR
) -> DataFrame:
    """Transactions per year and method, and their part of the year."""
    counts = _yearly_counts(
        between_years(sales, first, last), F.col("payment_method"), F.col("transaction_id")
    )
    return counts.withColumn("share", share(F.col("transactions"), "order_year"))


def focus_share(
    sales: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR
) -> DataFrame:
    """Share in percent of the methods under study and 'Other', with every year listed.

    A year without transactions has 0 transactions and no share.
    """
    counts = _yearly_counts(sales, focus_method(F.col("payment_method")), F.lit(1))
    years = F.sequence(F.lit(first), F.lit(last))
    grid = complete_grid(counts, "payment_method", "order_year", years, {"transactions": 0})
    percent = share(F.col("transactions"), "order_year") * 100
    return grid.withColumn("share_percent", percent)


def dominant_method(sales: DataFrame) -> DataFrame:
    """Most used method per year (first in alphabet on a tie) and its share in percent."""
    counts = _yearly_counts(sales, focus_method(F.col("payment_method")), F.lit(1))
    best = counts.groupBy("order_year").agg(
        F.min(F.struct((-F.col("transactions")).alias("n"), "payment_method")).alias("_best"),
        F.sum("transactions").alias("_all"),
    )
    return best.select(
        "order_year",
        F.col("_best.payment_method").alias("payment_method"),
        (ratio(-F.col("_best.n"), F.col("_all")) * 100).alias("share_percent"),
    )


def share_change(
    sales: DataFrame,
    methods: Sequence[str] = ("UPI", "COD"),
    first: int = FIRST_YEAR,
    last: int = LAST_YEAR,
) -> DataFrame:
    """Share in percent of each method in the first and the last year."""
    shares = focus_share(sales, first, last).where(F.col("payment_method").isin(*methods))
    return shares.groupBy("payment_method").agg(
        *[
            F.max(F.when(F.col("order_year") == year, F.col("share_percent"))).alias(name)
            for year, name in ((first, "first_share"), (last, "last_share"))
        ]
    )


def wallet_share(sales: DataFrame) -> DataFrame:
    """Share in percent per year under the label set with 'Digital Wallet'."""
    counts = _yearly_counts(sales, wallet_method(F.col("payment_method")), F.lit(1))
    percent = share(F.col("transactions"), "order_year") * 100
    return counts.withColumn("share_percent", percent)
