"""Joining per-key results back to the rows they came from, whatever the key distribution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators.settle import settle

# A summary with at most this many (narrow) rows is broadcast as a whole.
BROADCAST_ROWS = 100_000
# A key owning more than 1/1000 of all rows is "hot". At most 1000 keys can be.
HOT_FRACTION = 1000


def join_checked(
    df: DataFrame, small: DataFrame, keys: Sequence[str], broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Inner join with a result that is expected to be small.

    It is computed first and counted: broadcast if it is indeed small, else left
    to a shuffle join (on ``keys``, which spread even one group over many values).
    """
    kept = settle(small)
    return df.join(F.broadcast(kept) if kept.count() <= broadcast_rows else kept, list(keys))


def attach(
    facts: DataFrame,
    summary: DataFrame,
    keys: Sequence[str],
    rows: str,
    null_safe: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left-join ``summary`` (one row per key, ``rows`` = number of fact rows behind it).

    The summary is computed first and its size looked at. A small one is
    broadcast: facts stay where they are. A large one is split: rows of hot keys
    look their key up in a broadcast table (since the row counts of hot keys add
    up to at most the total, there can be no more than ``HOT_FRACTION`` of them,
    whatever the data); all other keys are each small and go through a plain
    shuffle join, to which only their rows are sent.

    With ``null_safe`` a missing key is a value like any other. Without it, facts
    with a missing key match nothing and skip the shuffle join, where they would
    all meet in one task.
    """
    attached = [c for c in summary.columns if c not in keys and c != rows]
    mirror = {key: f"_key_{i}" for i, key in enumerate(keys)}
    kept = settle(
        (summary if null_safe else summary.dropna(subset=list(keys))).select(
            *[F.col(key).alias(name) for key, name in mirror.items()],
            *attached,
            F.col(rows).alias("_weight"),
        )
    )
    size, weight = kept.agg(F.count(F.lit(1)), F.sum("_weight")).first()

    def equal(key: str):
        left, other = F.col(key), F.col(mirror[key])
        return left.eqNullSafe(other) if null_safe else left == other

    same = reduce(lambda a, b: a & b, [equal(key) for key in keys])
    columns = [*facts.columns, *attached]
    if size <= broadcast_rows:
        return facts.join(F.broadcast(kept), same, "left").select(*columns)

    threshold = weight / HOT_FRACTION
    hot = kept.where(F.col("_weight") > threshold)
    cold = kept.where(F.col("_weight") <= threshold).drop("_weight")
    missing = reduce(lambda a, b: a | b, [F.col(key).isNull() for key in keys])
    if null_safe:
        served = facts.join(F.broadcast(hot), same, "inner")
        others = facts
    else:
        served = facts.join(F.broadcast(hot), same, "left").where(
            F.col("_weight").isNotNull() | missing
        )
        others = facts.where(~missing)
    rest = others.join(F.broadcast(hot.select(*mirror.values())), same, "left_anti")
    rest = rest.join(cold, same, "left")
    return served.select(*columns).unionAll(rest.select(*columns))
