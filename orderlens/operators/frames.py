"""Row filters, column lookups, top-k, pivots and grids."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import as_column
from orderlens.operators.settle import settle

# A table wider than this is refused rather than cut.
MOST_COLUMNS = 2000

# Column names a dataset may use for the same thing, best first.
CANDIDATES: Mapping[str, tuple[str, ...]] = {
    "customer": ("customer_id", "cust_id", "buyer_id", "user_id"),
    "product": ("product_title", "product_name", "title", "product"),
    "quantity": ("quantity", "qty", "order_quantity"),
    "price": (
        "final_amount_inr",
        "subtotal_inr",
        "discounted_price_inr",
        "original_price_inr",
        "price",
    ),
    "location": ("state", "ship_state", "shipping_state", "customer_state", "city"),
}


def first_present(df: DataFrame, candidates: Iterable[str] | str) -> str | None:
    """First candidate that is a column of ``df``; decided from the schema, no job runs."""
    names = CANDIDATES[candidates] if isinstance(candidates, str) else candidates
    present = set(df.columns)
    return next((name for name in names if name in present), None)


def product_column(df: DataFrame) -> str:
    name = first_present(df, "product")
    if name is None:
        raise ValueError("no product column")
    return name


def with_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in which every key has a value.

    Stated as plain IS NOT NULL conditions: those reach the scan, and joins on the
    same keys later infer nothing new, so equal shuffles stay recognisable.
    """
    if not keys:
        return df
    return df.where(" AND ".join(f"`{key}` IS NOT NULL" for key in keys))


def between_dates(df: DataFrame, start, end, date: str = "order_date") -> DataFrame:
    """Inclusive day range, half-open inside so that no part of the last day is lost.

    When the table carries ``order_year`` (its partition column) the same range
    is also stated in years, so partitions outside it are never listed or read.
    """
    first, last = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    kept = df.where((F.col(date) >= first) & (F.col(date) < F.date_add(last, 1)))
    if "order_year" in df.columns and date != "order_year":
        kept = kept.where(F.col("order_year").between(F.year(first), F.year(last)))
    return kept


def between_years(df: DataFrame, first: int, last: int, year: str = "order_year") -> DataFrame:
    """Inclusive range of years, also stated in days where the table has ``order_date``."""
    kept = df.where(F.col(year).between(first, last))
    if year == "order_year" and "order_date" in df.columns:
        start, after = (F.lit(f"{y:04d}-01-01").cast("date") for y in (first, last + 1))
        kept = kept.where((F.col("order_date") >= start) & (F.col("order_date") < after))
    return kept


def top_rows(df: DataFrame, n: int, value: str, *ties: str) -> DataFrame:
    """The ``n`` largest by ``value``; each task keeps only its own best ``n``."""
    order = [F.col(value).desc_nulls_last(), *[F.col(tie).asc() for tie in ties]]
    return df.orderBy(*order).limit(n)


def keep_members(df: DataFrame, members: DataFrame, key: str, at_most: int) -> DataFrame:
    """Rows whose key is listed in ``members``.

    ``at_most`` states how many rows ``members`` can hold by construction (a
    top-k list). Short lists are broadcast, longer ones go through a shuffle join.
    """
    listed = members.select(key)
    return df.join(F.broadcast(listed) if at_most <= 10_000 else listed, key, "left_semi")


def value_counts(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """Rows per value, most frequent first; missing values get ``missing`` as label or drop out."""
    value = F.col(column)
    if missing is None:
        df = df.where(value.isNotNull())
    else:
        value = F.coalesce(value.cast("string"), F.lit(missing))
    counted = df.groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), F.asc(column))


def to_wide(
    long: DataFrame,
    index: str,
    header: str,
    value: str,
    headers: Sequence | None = None,
    prefix: str = "",
    fill: float | None = None,
) -> DataFrame:
    """Long to wide. ``headers`` lists values fixed by their meaning (months); else all values
    of the (already grouped) table become columns, found in a pass over it, in sorted order."""
    if headers is None:
        long = settle(long.select(index, header, value))
        found = long.select(header).distinct().where(F.col(header).isNotNull())
        headers = [row[0] for row in found.orderBy(header).limit(MOST_COLUMNS + 1).collect()]
        if len(headers) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} columns; use matrix_cells")
    cells = []
    for name in headers:
        cell = F.sum(F.when(F.col(header) == F.lit(name), F.col(value)))
        if fill is not None:
            cell = F.coalesce(cell, F.lit(fill))
        cells.append(cell.alias(f"{prefix}{name}"))
    return long.groupBy(index).agg(*cells)


def complete_grid(
    totals: DataFrame,
    by: str,
    axis: str,
    values: Column,
    fill: Mapping[str, object],
) -> DataFrame:
    """Every ``by`` value combined with every entry of the array ``values``.

    ``totals`` is already grouped. Its distinct ``by`` values are unfolded over
    the array, so no join without keys is needed; absent cells take ``fill``.
    """
    spine = totals.select(by).distinct().withColumn("_axis", values)
    spine = spine.select(by, F.explode("_axis").alias(axis))
    filled = spine.join(totals, [by, axis], "left")
    return filled.select(
        *[
            F.coalesce(F.col(c), as_column(F.lit(fill[c]))).alias(c) if c in fill else F.col(c)
            for c in filled.columns
        ]
    )


def matrix_cells(
    totals: DataFrame, index: str, header: str, value: str, fill: object
) -> DataFrame:
    """All cells of a matrix in long form, absent ones filled; ``totals`` is already grouped."""
    kept = settle(with_keys(totals, index, header).select(index, header, value))
    return complete_grid(kept, index, header, observed_values(kept, header), {value: fill})


def observed_values(df: DataFrame, column: str) -> Column:
    """Sorted array of the values present, as a scalar subquery.

    Only for columns whose number of values is bounded by their meaning
    (calendar years, labels of a fixed set).
    """
    return (
        df.where(F.col(column).isNotNull())
        .select(column)
        .distinct()
        .agg(F.sort_array(F.collect_list(column)).alias("all"))
        .scalar()
    )


def distinct_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()
