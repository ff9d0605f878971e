"""Product ratings and what they go along with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.bins import PRICE_LABELS, price_bin
from orderlens.functions.numeric import mean, total
from orderlens.operators.frames import with_keys
from orderlens.operators.histogram import density, histogram
from orderlens.operators.settle import settle
from orderlens.operators.statistics import correlation_matrix


def rating_histogram(sales: DataFrame, bins: int = 20, by_subcategory: bool = False) -> DataFrame:
    return histogram(sales, "product_rating", bins, ["subcategory"] if by_subcategory else [])


def rating_density(sales: DataFrame, points: int = 200, by_subcategory: bool = False) -> DataFrame:
    keys = ["subcategory"] if by_subcategory else []
    return density(sales, "product_rating", points, keys=keys)


def product_ratings(sales: DataFrame) -> DataFrame:
    """Mean rating, quantity and revenue per product."""
    keys = ["product_id", "subcategory"]
    return (
        with_keys(sales, "product_rating", *keys)
        .groupBy(*keys)
        .agg(
            mean("product_rating").alias("average_rating"),
            total("quantity").alias("quantity"),
            total("final_amount").alias("revenue"),
        )
    )


def rating_correlation(sales: DataFrame) -> DataFrame:
    return correlation_matrix(product_ratings(sales), ["average_rating", "quantity", "revenue"])


def rating_by_price(sales: DataFrame) -> DataFrame:
    """Mean rating, quantity and revenue per price bin, all bins listed.

    The last bin ends before the highest price, which therefore falls in none.
    """
    rated = with_keys(sales, "product_rating")
    highest = rated.agg(F.max("original_price").alias("h")).scalar()
    grouped = (
        rated.withColumn("_highest", highest)
        .withColumn("price_bin", price_bin(F.col("original_price"), F.col("_highest")))
        .groupBy("price_bin")
        .agg(
            mean("product_rating").alias("average_rating"),
            total("quantity").alias("quantity"),
            total("final_amount").alias("revenue"),
        )
    )
    # A row per label of a fixed set, kept for the spine and the join: absent labels are filled in.
    grouped = settle(grouped)
    labels = F.array(*[F.lit(label) for label in PRICE_LABELS])
    spine = grouped.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(labels).alias("price_bin"))
    return spine.join(grouped, "price_bin", "left").select(
        "price_bin",
        "average_rating",
        F.coalesce("quantity", F.lit(0)).alias("quantity"),
        F.coalesce("revenue", F.lit(0)).alias("revenue"),
    )
