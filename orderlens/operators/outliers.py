"""Price outliers within (subcategory, brand)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.operators.quantiles import binned, bin_table, locate, merged_moments, quantiles_at, values_in
from orderlens.operators.skew import attach

# Fixed values
PRICE_GROUP = ("subcategory", "brand")
IQR_FACTOR = 1.5
SIGMA_FACTOR = 3


def fences(df: DataFrame, price: str, keys: Sequence[str] = PRICE_GROUP, iqr: bool = True) -> DataFrame:
    """``keys, _rows``, 1.5 IQR below and above the quartiles, and three sample deviations around the mean.

    One grouping by (keys, bin) carries counts, extremes and moments, from which both kinds of
    fences come; a second read looks only at the bins that hold a quartile (none without
    ``iqr``). ``_rows`` counts all rows of a group, with a price or without. Groups without
    spread have no sigma fences.
    """
    keys, probs = list(keys), [0.25, 0.75]
    rows = binned(df, price, keys)
    table = bin_table(rows, keys, moments=True)
    moments = merged_moments(table, keys)
    reach = SIGMA_FACTOR * F.when(F.col("std") > 0, F.col("std"))
    found = moments.select(
        *keys,
        F.col("_weight").alias("_rows"),
        (F.col("mean") - reach).alias("_sigma_low"),
        (F.col("mean") + reach).alias("_sigma_high"),
    )
    if not iqr:
        return found
    located = locate(table, probs, keys)
    several = located.where("_low < _high").select(*keys, "_bin")
    quartiles = quantiles_at(located, values_in(rows, several, keys), probs, keys)
    reach = IQR_FACTOR * (F.col("q1") - F.col("q0"))
    edges = quartiles.select(
        *keys, (F.col("q0") - reach).alias("_iqr_low"), (F.col("q1") + reach).alias("_iqr_high")
    )
    return found.join(edges, keys, "left")


def _outside(price: str, low: str, high: str) -> Column:
    amount = F.col(price).cast("double")
    return F.coalesce((amount < F.col(low)) | (amount > F.col(high)), F.lit(False))


EDGES = ("_iqr_low", "_iqr_high", "_sigma_low", "_sigma_high")


def flag_iqr_outliers(
    df: DataFrame, price: str = "original_price", keys: Sequence[str] = PRICE_GROUP
) -> DataFrame:
    """Add ``price_outlier_iqr``; a missing price or key flags nothing."""
    fenced = attach(df, fences(df, price, keys), keys, "_rows")
    flag = _outside(price, "_iqr_low", "_iqr_high")
    return fenced.withColumn("price_outlier_iqr", flag).drop(*EDGES)


def flag_sigma_outliers(
    df: DataFrame, price: str = "original_price", keys: Sequence[str] = PRICE_GROUP
) -> DataFrame:
    """Add ``price_outlier_3_sigma``; a missing price or key flags nothing."""
    fenced = attach(df, fences(df, price, keys, iqr=False), keys, "_rows")
    flag = _outside(price, "_sigma_low", "_sigma_high")
    return fenced.withColumn("price_outlier_3_sigma", flag).drop(*EDGES)


def flag_price_outliers(
    df: DataFrame, price: str = "original_price", keys: Sequence[str] = PRICE_GROUP
) -> DataFrame:
    """Both flags from one table of statistics: ``df`` is read three times, the last time for the flags."""
    fenced = attach(df, fences(df, price, keys), keys, "_rows")
    return (
        fenced.withColumn("price_outlier_iqr", _outside(price, "_iqr_low", "_iqr_high"))
        .withColumn("price_outlier_3_sigma", _outside(price, "_sigma_low", "_sigma_high"))
        .drop(*EDGES)
    )
