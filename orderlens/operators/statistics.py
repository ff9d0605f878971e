"""Correlation matrices and trend lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL for a constant column.

    (The built-in ``corr`` raises a division error on a constant column in ANSI mode.)
    """
    a, b = a.cast("double"), b.cast("double")
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, r`` for every ordered pair; one pass over the data computes all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    once = df.agg(
        *[correlation(F.col(a), F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(
                F.struct(F.lit(left).alias("a"), F.lit(right).alias("b"), F.col(f"_{i}").alias("r"))
            )
    return once.select(F.inline(F.array(*cells)))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line ``y = intercept + slope * x``, one row."""
    across, up = F.col(x).cast("double"), F.col(y).cast("double")
    both = across.isNotNull() & up.isNotNull()
    parts = df.where(both).agg(
        F.covar_pop(across, up).alias("_cov"),
        F.var_pop(across).alias("_var"),
        F.avg(across).alias("_x"),
        F.avg(up).alias("_y"),
    )
    slope = F.try_divide(F.col("_cov"), F.col("_var"))
    return parts.select(slope.alias("slope"), (F.col("_y") - slope * F.col("_x")).alias("intercept"))
