"""Previous/next-row logic per customer or product, safe for a customer with very many rows.

A plain ``lag`` over the customer sorts all of a customer's rows in one task.
Here rows first meet per (customer, day); what crosses a day boundary is carried
by one summary row per customer and day, so the window over the customer holds
at most one row per calendar day. A day of more rows than one task should sort is
cut into ranges of its order, and each range carries its first and last row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.operators.frames import with_keys
from orderlens.operators.settle import settle, stage

# One task sorts at most about so many rows of one key and day.
BUDGET = 500_000


def day_visits(df: DataFrame, key: str, date: str) -> DataFrame:
    """``key, date, rows, previous_date, next_date``: one row per key and day."""
    days = with_keys(df, key, date).groupBy(key, date).agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy(key).orderBy(date)
    return days.withColumn("previous_date", F.lag(date).over(order)).withColumn(
        "next_date", F.lead(date).over(order)
    )


def day_gaps(df: DataFrame, key: str, date: str) -> DataFrame:
    """``days, n``: how often two consecutive rows of a key are ``days`` apart.

    Of ``rows`` rows on one day all but the first follow a row of the same day
    (gap 0); the first follows the previous day with rows.
    """
    visits = day_visits(df, key, date)
    across = F.when(F.col("previous_date").isNotNull(), F.lit(1)).cast("bigint")
    pieces = F.array(
        F.struct(F.datediff(date, "previous_date").alias("days"), across.alias("n")),
        F.struct(F.lit(0).alias("days"), (F.col("rows") - 1).alias("n")),
    )
    return visits.select(F.inline(pieces)).where("n > 0").groupBy("days").agg(F.sum("n").alias("n"))


def _segments(rows: DataFrame, key: str, date: str, order: Sequence[str], budget: int) -> DataFrame:
    """``rows`` with ``_range``: 0, or for crowded (key, date) pairs the number of a range of ``order``.

    Crowded pairs are few (all rows divided by the budget at most), so they are broadcast; only
    their rows are parted by range, which a single pair fills evenly. Range numbers grow with
    the order.
    """
    crowded = settle(
        rows.groupBy(key, date).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > budget)
    )
    total = crowded.agg(F.sum("_rows")).first()[0]
    usual = rows.withColumn("_range", F.lit(0))
    if not total:
        return usual
    pairs = F.broadcast(crowded.select(key, date))
    parted = rows.join(pairs, [key, date], "left_semi").repartitionByRange(
        2 * -(-total // budget), key, date, *order
    )
    # The parts are written, so that every later step sees the same numbers.
    ranges = stage(parted.withColumn("_range", F.spark_partition_id() + 1))
    return usual.join(pairs, [key, date], "left_anti").unionByName(ranges)


def transitions(
    df: DataFrame, key: str, date: str, order: Sequence[str], value: str, budget: int = BUDGET
) -> DataFrame:
    """``previous, following, count`` over consecutive rows of a key, both values present.

    ``df`` is read once; its four columns are kept in the shared folder. No task sorts more
    than about ``budget`` rows of a key and day, whatever a day holds.
    """
    narrow = [key, date, *[c for c in order if c not in (key, date)], value]
    rows = with_keys(df, key, date).select(*dict.fromkeys(narrow))
    rows = _segments(stage(rows), key, date, order, budget)
    in_range = Window.partitionBy(key, date, "_range").orderBy(*order)
    inside = rows.select(
        F.lag(value).over(in_range).alias("previous"), F.col(value).alias("following")
    )
    # First and last of every range by partial aggregation: nothing is sorted a second time.
    place = F.struct(*order)
    ends = rows.groupBy(key, date, "_range").agg(
        F.min_by(value, place).alias("_first"), F.max_by(value, place).alias("_last")
    )
    by_key = Window.partitionBy(key).orderBy(date, "_range")
    across = ends.select(
        F.lag("_last").over(by_key).alias("previous"), F.col("_first").alias("following")
    )

    def pairs(df: DataFrame) -> DataFrame:
        kept = df.where(F.col("previous").isNotNull() & F.col("following").isNotNull())
        return kept.groupBy("previous", "following").agg(F.count(F.lit(1)).alias("n"))

    both = pairs(inside).unionAll(pairs(across))
    return both.groupBy("previous", "following").agg(F.sum("n").alias("count"))


def first_and_last(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """``key, rows, first_<value>, last_<value>``: first and last *present* value per key."""
    present = F.col(value).isNotNull()
    position = F.when(present, F.struct(*order))
    return (
        with_keys(df, key)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min_by(value, position).alias(f"first_{value}"),
            F.max_by(value, position).alias(f"last_{value}"),
        )
    )


def rolling_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int) -> DataFrame:
    """Add ``rolling``: mean of the last ``rows`` rows, shorter at the start of a group."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, Window.currentRow)
    mean = F.sum(F.col(value).cast("double")).over(frame) / F.count(value).over(frame)
    return df.withColumn("rolling", mean)


def is_declining(
    df: DataFrame, keys: Sequence[str], order: str, value: str, last: int = 5
) -> DataFrame:
    """``keys, periods, is_declining``: are the latest ``last`` values strictly decreasing?

    With one period there is nothing to compare and the answer is true;
    ``periods`` lets callers leave such groups out.
    """
    latest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    numbered = df.withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= last)
    # One step further back in time is the next row of the descending order.
    earlier = F.lead(value).over(latest)
    stepped = numbered.withColumn("_falls", earlier > F.col(value))
    return stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"),
        F.coalesce(F.bool_and("_falls"), F.lit(True)).alias("is_declining"),
    )
