"""Equal-width histograms and kernel densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import as_column
from orderlens.operators.frames import with_keys
from orderlens.operators.settle import settle
from orderlens.operators.skew import attach


def _bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0..bins-1; the maximum belongs to the last bin, a zero range to the first."""
    width = high - low
    place = F.floor((value - low) * bins / width)
    return F.when(width > 0, F.least(place, F.lit(bins - 1))).otherwise(0).cast("int")


def histogram(
    df: DataFrame,
    value: Column | str,
    bins: int,
    keys: Sequence[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """``keys, bin, bin_start, bin_end, count`` with every one of the ``bins`` present.

    One pass finds the range, one counts; both combine before the shuffle, so a
    task sends at most ``bins`` rows per group.
    """
    keys = list(keys)
    amount = as_column(value).cast("double")
    rows = (
        with_keys(df, *keys)
        .where(as_column(value).isNotNull())
        .select(*keys, amount.alias("_x"), (F.lit(1) if weight is None else weight).alias("_w"))
    )
    bounds = rows.groupBy(*keys).agg(
        F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count(F.lit(1)).alias("_rows")
    )
    if keys:
        bounds = settle(bounds)
        located = attach(rows, bounds, keys, "_rows")
    else:
        bounds = bounds.where(F.col("_low").isNotNull())
        one = bounds.select(F.struct("_low", "_high").alias("b")).scalar()
        located = rows.withColumn("_b", one).select("_x", "_w", "_b.*")
    place = _bin_of(F.col("_x"), F.col("_low"), F.col("_high"), bins)
    counts = located.groupBy(*keys, place.alias("bin")).agg(F.sum("_w").alias("count"))
    spine = bounds.select(
        *keys, "_low", "_high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )

    step = (F.col("_high") - F.col("_low")) / bins
    return spine.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("_low") + step * F.col("bin")).alias("bin_start"),
        (F.col("_low") + step * (F.col("bin") + 1)).alias("bin_end"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
    )


def density(
    df: DataFrame,
    value: Column | str,
    points: int = 200,
    resolution: int = 512,
    keys: Sequence[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) on ``points`` grid points from min to max.

    Kernels sit at the centres of ``resolution`` histogram bins, so the work after
    the histogram is ``resolution * points`` per group, however many rows there are.
    """
    keys = list(keys)
    table = settle(histogram(df, value, resolution, keys, weight))
    center = (F.col("bin_start") + F.col("bin_end")) / 2
    # Weighted sample deviation of the binned data, from two exact sums about the low end.
    offset = center - F.col("_low")
    n = F.sum("count")
    ranged = table.groupBy(*keys).agg(
        F.min("bin_start").alias("_low"), F.max("bin_end").alias("_high"), n.alias("_n")
    )
    if keys:
        placed = table.join(ranged, keys)
    else:
        one = ranged.select(F.struct("_low", "_high", "_n").alias("r")).scalar()
        placed = table.withColumn("_r", one).select("*", "_r.*")
    moments = placed.groupBy(*keys).agg(
        F.max("_low").alias("_low"),
        F.max("_high").alias("_high"),
        F.max("_n").alias("_n"),
        F.sum(offset * F.col("count")).alias("_s1"),
        F.sum(offset * offset * F.col("count")).alias("_s2"),
    )
    n = F.col("_n")
    variance = F.try_divide(F.col("_s2") - F.try_divide(F.col("_s1") * F.col("_s1"), n), n - 1)
    bandwidth = F.sqrt(variance) * F.pow(n.cast("double"), F.lit(-0.2))
    scaled = moments.select(*keys, "_low", "_high", "_n", bandwidth.alias("_h")).where("_h > 0")
    if keys:
        kernels = table.where("count > 0").join(scaled, keys)
    else:
        one = scaled.select(F.struct("_low", "_high", "_n", "_h").alias("s")).scalar()
        kernels = table.where("count > 0").withColumn("_s", one).select("*", "_s.*")
    at = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("point") / (points - 1)
    spread = (
        kernels.where("_h is not null")
        .withColumn("_center", center)
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", at)
    )
    z = (F.col("x") - F.col("_center")) / F.col("_h")
    height = F.col("count") * F.exp(z * z * -0.5)
    scale = F.max("_n") * F.max("_h") * math.sqrt(2 * math.pi)
    return spread.groupBy(*keys, "point").agg(
        F.max("x").alias("x"), (F.sum(height) / scale).alias("density")
    )
