"""Duplicate detection, classification and consolidation."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators.settle import settle, stage
from orderlens.operators.skew import attach

# ---- Fixed values -----------------------------------------------------------------
DUPLICATE_KEYS = (
    "order_date",
    "customer_id",
    "product_id",
    "original_price",
    "discounted_price",
    "final_amount",
)
BULK_ORDER, ERROR_DUPLICATE, NORMAL = "bulk_order", "error_duplicate", "normal"
TOLERANCE = 0.01
NO_MONTH = "none"
# The table of repeated hashes: bits per hash, its least and greatest size in bits (8 KB to 32 MB).
BITS_PER_HASH = 32
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
# -------------------------------------------------------------------------------------


class Repeats(NamedTuple):
    """Bits of the hashes of the key combinations that occur more than once.

    ``table`` holds 512 bits a row (``_piece``, ``_words``), rows without a bit are left out; ``bits`` is the
    number of places.
    """

    table: DataFrame
    bits: int


def _place(keys: Sequence[str], bits: int) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit(bits - 1))


def repeated_hashes(df: DataFrame, keys: Sequence[str] = DUPLICATE_KEYS, most_bits: int = MOST_BITS) -> Repeats:
    """Which key combinations may occur more than once, from one narrow grouping of their hashes.

    The table is small enough to be broadcast, whatever the data: with more hashes than it has room
    for, more rows that occur once pass as possibly repeated, and none that is repeated is missed.
    """
    counted = df.groupBy(F.xxhash64(*keys).alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = settle(counted.where("_n > 1").select("_hash"))
    wanted = min(max(repeated.count() * BITS_PER_HASH, LEAST_BITS), most_bits)
    bits = 1 << (wanted - 1).bit_length()
    place = F.col("_hash").bitwiseAND(F.lit(bits - 1))
    words = [f"coalesce(bit_or(shiftleft(1L, cast(_at & 63 AS int))) FILTER (WHERE shiftright(_at, 6) & 7 = {i}), 0L)" for i in range(8)]
    pieces = repeated.select(place.alias("_at")).groupBy(F.expr("shiftright(_at, 9)").alias("_piece"))
    return Repeats(settle(pieces.agg(F.expr(f"array({', '.join(words)})").alias("_words"))), bits)


def parted(df: DataFrame, repeats: Repeats, keys: Sequence[str] = DUPLICATE_KEYS) -> tuple[DataFrame, DataFrame]:
    """Rows that certainly occur once, and the others; no row is shuffled."""
    placed = df.withColumn("_at", _place(keys, repeats.bits)).join(
        F.broadcast(repeats.table), F.expr("shiftright(_at, 9) = _piece"), "left"
    )
    bit = "coalesce(getbit(_words[cast(shiftright(_at, 6) & 7 AS int)], cast(_at & 63 AS int)) = 1, false)"
    return tuple(placed.where(F.expr(bit) == flag).select(*df.columns) for flag in (F.lit(False), F.lit(True)))


def duplicate_summary(
    df: DataFrame,
    keys: Sequence[str] = DUPLICATE_KEYS,
    quantity: str = "quantity",
    amount: str = "final_amount",
    row_id: str = "transaction_id",
    totals: Sequence[str] = (),
) -> DataFrame:
    """One row per key combination, single rows included; summaries can be merged (``merged_summary``)."""
    first = F.struct(F.col(row_id).alias("id"), F.col(quantity).alias("q"), F.col(amount).alias("a"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"),
        F.sum(quantity).alias("total_quantity"),
        F.sum(F.col(amount)).alias("total_amount"),
        F.min(first).alias("_first"),
        *[F.sum(name).alias(f"total_{name}") for name in totals],
    )


def merged_summary(summary: DataFrame, keys: Sequence[str] = DUPLICATE_KEYS) -> DataFrame:
    """Summaries of several tables, united, as the summary of all their rows (types unchanged)."""
    sums = [f for f in summary.schema.fields if f.name == "copies" or f.name.startswith("total_")]
    return summary.groupBy(*keys).agg(
        *[F.sum(f.name).cast(f.dataType).alias(f.name) for f in sums], F.min("_first").alias("_first")
    ).select(*summary.columns)


def judged(summary: DataFrame, keys: Sequence[str] = DUPLICATE_KEYS) -> DataFrame:
    """The combinations that occur more than once, with their class."""
    grouped = summary.where(F.col("copies") > 1)
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    unit = F.try_divide(F.col("_first.a").cast("double"), F.col("_first.q").cast("double"))
    off = F.abs(F.col("total_quantity") * unit - F.col("total_amount").cast("double"))
    kind = (
        F.when(missing, NORMAL).when(off < TOLERANCE, BULK_ORDER).otherwise(ERROR_DUPLICATE)
    )
    return grouped.withColumn("duplicate_type", kind).drop("_first")


def duplicate_groups(df: DataFrame, keys: Sequence[str] = DUPLICATE_KEYS, **names) -> DataFrame:
    """One row per key combination that occurs more than once, with its class.

    A group is a bulk order when its quantities explain its amounts at the unit
    price of the first row (by ``row_id``); groups with a missing key are not
    judged and stay 'normal'. Grouping combines copies before the shuffle, so a
    key with very many copies costs one row per task. ``df`` is read twice: first for the
    hashes of its keys, then only rows whose hash is repeated are grouped. ``names`` are
    those of ``duplicate_summary``.
    """
    _, several = parted(df, repeated_hashes(df, keys), keys)
    return judged(duplicate_summary(several, keys, **names), keys)


# ---- A summary that is kept, and grows with every year's file -------------------------------


def _month(date: str) -> Column:
    """Copies share their date, so a month of the summary is complete by itself."""
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(NO_MONTH))


def write_summary(
    df: DataFrame, path: str, keys: Sequence[str] = DUPLICATE_KEYS, date: str = "order_date", **names
) -> None:
    """The summary of ``df`` by months of ``date``, one of the keys, replacing what is at ``path``.

    ``df`` is read three times, here and in ``add_to_summary``.
    """
    _save(_monthly_summary(df, keys, date, **names), path, "static")


def _monthly_summary(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    quantity: str = "quantity",
    amount: str = "final_amount",
    row_id: str = "transaction_id",
    totals: Sequence[str] = (),
) -> DataFrame:
    """``duplicate_summary`` with ``month``; rows of a month come together in as many tasks as they fill.

    Only rows whose key may be repeated are grouped. A row that occurs once is its own summary, which is
    spelled out behind the shuffle.
    """
    needed = list(dict.fromkeys([*keys, row_id, quantity, amount, *totals]))
    single, several = parted(df.select(*needed), repeated_hashes(df, keys), keys)
    grouped = duplicate_summary(several, keys, quantity, amount, row_id, totals)
    read_from = {"total_quantity": quantity, "total_amount": amount, **{f"total_{name}": name for name in totals}}
    sums = [
        F.col(read_from[f.name]).cast(f.dataType).alias(f.name) for f in grouped.schema.fields if f.name in read_from
    ]
    first = F.struct(F.col(row_id).alias("id"), F.col(quantity).alias("q"), F.col(amount).alias("a"))
    alone = _by_month(single.withColumn("month", _month(date))).select(
        *keys, F.lit(1).cast("bigint").alias("copies"), *sums, first.alias("_first"), "month"
    )
    together = _by_month(grouped.withColumn("month", _month(date)))
    return alone.select(*together.columns).unionAll(together)


def _by_month(df: DataFrame) -> DataFrame:
    return df.hint("rebalance", F.col("month"))


def _save(summary: DataFrame, path: str, mode: str) -> None:
    writer = summary.write.mode("overwrite").partitionBy("month")
    writer.option("partitionOverwriteMode", mode).parquet(path)


def add_to_summary(
    df: DataFrame, path: str, keys: Sequence[str] = DUPLICATE_KEYS, date: str = "order_date", **names
) -> DataFrame:
    """Merge new rows into the summary at ``path``; returns the groups of their keys, judged anew.

    Only the months in which the new rows lie are read and rewritten, so a new year's file
    costs what it holds itself; months the summary did not hold are added as they are. A failed run leaves every month as it was or as it should be;
    adding the same rows twice counts them twice.
    """
    spark = df.sparkSession
    new = stage(_monthly_summary(df, keys, date, **names))
    # At most one value per month of the calendar.
    months = [r.month for r in new.select("month").distinct().collect()]
    old = spark.read.parquet(path).where(F.col("month").isin(months)).select(*new.columns)
    held = F.col("month").isin([r.month for r in old.select("month").distinct().collect()])
    fresh, known = new.where(~held), new.where(held)
    merged = stage(_by_month(merged_summary(old.unionAll(known), [*keys, "month"])))
    _save(fresh.unionAll(merged), path, "dynamic")
    same = [F.col(f"m.{key}").eqNullSafe(F.col(f"n.{key}")) for key in keys]
    touched = fresh.unionAll(merged.alias("m").join(known.select(*keys).alias("n"), same, "left_semi"))
    return judged(touched.drop("month"), keys)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")


def attach_classes(
    df: DataFrame, groups: DataFrame, keys: Sequence[str] = DUPLICATE_KEYS
) -> DataFrame:
    """Add ``is_duplicate`` (missing keys equal each other) and ``duplicate_type`` to every row."""
    classes = groups.select(*keys, "copies", "duplicate_type", F.lit(True).alias("is_duplicate"))
    labelled = attach(df, classes, keys, "copies", null_safe=True)
    return labelled.withColumn(
        "is_duplicate", F.coalesce("is_duplicate", F.lit(False))
    ).withColumn("duplicate_type", F.coalesce("duplicate_type", F.lit(NORMAL)))


def classify_duplicates(
    df: DataFrame, keys: Sequence[str] = DUPLICATE_KEYS, repeats: Repeats | None = None, **names
) -> DataFrame:
    """Every row with its class, as ``attach_classes`` adds it.

    Only rows whose key may be repeated are kept aside, grouped and joined; the others stay where
    they are. ``repeats`` is given where the keys can be read from a plainer table than ``df``.
    """
    single, several = parted(df, repeats or repeated_hashes(df, keys), keys)
    kept = stage(several)
    classed = attach_classes(kept, judged(duplicate_summary(kept, keys, **names), keys), keys)
    alone = single.withColumns({"is_duplicate": F.lit(False), "duplicate_type": F.lit(NORMAL)})
    return alone.select(*classed.columns).unionAll(classed)


def bulk_order_totals(
    df: DataFrame,
    keys: Sequence[str] = DUPLICATE_KEYS,
    row_id: str = "transaction_id",
    totals: Sequence[str] = (),
) -> DataFrame:
    """One row per bulk order with its totals, however many rows it has."""
    groups = duplicate_groups(df, keys, row_id=row_id, totals=totals)
    return groups.where(F.col("duplicate_type") == BULK_ORDER).drop("duplicate_type")


def bulk_order_members(
    df: DataFrame, keys: Sequence[str] = DUPLICATE_KEYS, row_id: str = "transaction_id"
) -> DataFrame:
    """Long form: the keys of every bulk order with each of its row ids, one per row."""
    rows = _repeated_rows(df, keys, row_id)
    return _members(rows, _orders(rows, keys, row_id), keys, row_id)


def _repeated_rows(df: DataFrame, keys: Sequence[str], row_id: str, totals: Sequence[str] = ()) -> DataFrame:
    """The rows whose key may be repeated, kept: all members of bulk orders are among them."""
    needed = list(dict.fromkeys([*keys, row_id, "quantity", "final_amount", *totals]))
    _, several = parted(df.select(*needed), repeated_hashes(df, keys), keys)
    return stage(several)


def _orders(rows: DataFrame, keys: Sequence[str], row_id: str, totals: Sequence[str] = ()) -> DataFrame:
    groups = judged(duplicate_summary(rows, keys, row_id=row_id, totals=totals), keys)
    return groups.where(F.col("duplicate_type") == BULK_ORDER).drop("duplicate_type")


def _members(rows: DataFrame, orders: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    marked = orders.select(*keys, "copies", F.lit(True).alias("_bulk"))
    found = attach(rows.select(*keys, row_id), marked, keys, "copies")
    return found.where("_bulk").drop("_bulk")


def consolidate_bulk_orders(
    df: DataFrame,
    keys: Sequence[str] = DUPLICATE_KEYS,
    row_id: str = "transaction_id",
    totals: Sequence[str] = (),
) -> DataFrame:
    """One row per bulk order with its totals and its row ids as one text, always.

    The text grows with the order; where orders may be huge, use
    ``bulk_order_totals`` and ``bulk_order_members`` instead.
    """
    rows = _repeated_rows(df, keys, row_id, totals)
    orders = stage(_orders(rows, keys, row_id, totals))
    ids = F.array_sort(F.collect_list(F.col(row_id).cast("string")))
    members = _members(rows, orders, keys, row_id).groupBy(*keys).agg(
        F.array_join(ids, ",").alias("transaction_ids")
    )
    return orders.drop("copies").join(members, list(keys))
