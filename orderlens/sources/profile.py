"""Shape, missing values and distinct values of any table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.numeric import ratio


def profile(df: DataFrame, distinct: str = "none") -> DataFrame:
    """One row per column: type, rows, missing, missing share in percent, distinct values.

    All columns are counted in one pass. ``distinct``: 'none', 'approx' (one
    pass, a sketch per column) or 'exact' (shuffles each column's values).
    """
    counters = {"approx": F.approx_count_distinct, "exact": F.count_distinct}
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, field in enumerate(df.schema.fields):
        column = F.col(f"`{field.name}`")
        missing = column.isNull()
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            missing = missing | F.isnan(column)
        aggregates.append(F.count_if(missing).alias(f"_m{i}"))
        if distinct in counters:
            aggregates.append(counters[distinct](column).alias(f"_d{i}"))
    lines = [
        F.struct(
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.col("_rows").alias("rows"),
            F.col(f"_m{i}").alias("missing"),
            (ratio(F.col(f"_m{i}"), F.col("_rows")) * 100).alias("missing_percent"),
            (F.col(f"_d{i}") if distinct in counters else F.lit(None).cast("bigint")).alias(
                "distinct_values"
            ),
        )
        for i, field in enumerate(df.schema.fields)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*lines)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
