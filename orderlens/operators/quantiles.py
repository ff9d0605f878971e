"""Exact quantiles and box-plot statistics, in two reads and without a group in one task.

The first read counts rows per group and coarse, data-independent bin, with the least and
greatest value of each bin. These counts locate every wanted rank in a bin. A bin of a single
value needs no more; the rows of the other wanted bins, and only those, are read once more,
counted per distinct value and kept. A bin that still holds more distinct values than one
task should sort is cut again between its own least and greatest value, as often as needed:
each cut parts its extremes, so even values that differ in the last digit only come apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import as_column, ratio
from orderlens.operators.frames import with_keys
from orderlens.operators.settle import settle, stage
from orderlens.operators.skew import BROADCAST_ROWS, attach

BINS_PER_E_FOLD = 256
# One task sorts at most so many distinct values of a bin; a fuller bin is cut into FAN pieces.
BUDGET = 500_000
FAN = 1024


def value_bin(value: Column) -> Column:
    """Bin number that never decreases as ``value`` grows.

    Far from zero bins are 0.4 % wide, below 1 they are 0.004 wide: twelve decades need a
    few thousand of them, whatever the data. How many rows a bin holds is up to the data.
    """
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * BINS_PER_E_FOLD)


def value_table(
    df: DataFrame, value: Column | str, keys: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """``keys, value, n``: how often each distinct value occurs.

    Equal values collapse before the shuffle, and the shuffle is on the value
    too, so a hot group is spread over all tasks.
    """
    amount = as_column(value).cast("double")
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        with_keys(df, *keys)
        .groupBy(*keys, amount.alias("value"))
        .agg(counted.cast("bigint").alias("n"))
        .where(F.col("value").isNotNull())
    )


def binned(df: DataFrame, value: Column | str, keys: Sequence[str]) -> DataFrame:
    """``keys, _amount, value, _bin`` of the rows whose keys are present."""
    amount = as_column(value)
    rows = with_keys(df, *keys).select(
        *keys, amount.alias("_amount"), amount.cast("double").alias("value")
    )
    return rows.withColumn("_bin", value_bin(F.col("value")))


def bin_table(rows: DataFrame, keys: Sequence[str], moments: bool = False) -> DataFrame:
    """One row per group and bin, computed once; rows without a value have a bin of their own (null).

    ``_all`` counts the rows, ``_n`` those with a value, ``_low`` and ``_high`` are the extremes.
    With ``moments`` also the sum (``_total``, in the column's own type), mean and sum of
    squared deviations. All of these can be merged over bins.
    """
    more = [
        F.sum("_amount").alias("_total"),
        F.avg("value").alias("_mean"),
        (F.var_pop("value") * F.count("value")).alias("_m2"),
    ]
    return settle(
        rows.groupBy(*keys, "_bin").agg(
            F.count(F.lit(1)).alias("_all"),
            F.count("value").alias("_n"),
            F.min("value").alias("_low"),
            F.max("value").alias("_high"),
            *(more if moments else []),
        )
    )


def locate(table: DataFrame, probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """The bins that hold wanted ranks, computed once: ``keys, _bin, _low, _high, _n, rows, _before, _wanted``."""

    # The two neighbours of every wanted position, as ranks counted from 0.
    def neighbour(which: int, prob: float, side: int) -> str:
        at = f"(cast({prob!r} AS double) * (rows - 1))"
        rank = f"floor({at})" if side == 0 else f"ceil({at})"
        return f"struct({which} AS which, {side} AS side, {rank} AS rank, {at} - floor({at}) AS part)"

    wanted = ", ".join(
        neighbour(i, float(p), side) for i, p in enumerate(probs) for side in (0, 1)
    )
    in_keys = ", ".join(keys) or "0"
    # A group has a few thousand bins at most, so these windows are over short groups.
    placed = table.where("_n > 0").selectExpr(
        *keys, "_bin", "_low", "_high", "_n",
        f"sum(_n) OVER (PARTITION BY {in_keys}) AS rows",
        f"sum(_n) OVER (PARTITION BY {in_keys} ORDER BY _bin "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - _n AS _before",
    )
    return settle(
        placed.withColumn(
            "_wanted",
            F.expr(f"filter(array({wanted}), w -> w.rank >= _before AND w.rank < _before + _n)"),
        ).where("size(_wanted) > 0")
    )


def _joined(rows: DataFrame, cells: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join with cells that are already computed: broadcast if they are few."""
    return rows.join(F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells, list(on))


def values_in(rows: DataFrame, bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, _bin, value, _w``: the distinct values in some bins and their counts, read once and kept."""
    found = _joined(rows, bins, [*keys, "_bin"])
    return stage(found.groupBy(*keys, "_bin", "value").agg(F.count(F.lit(1)).alias("_w")))


def _cut(values: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pieces of ``cells`` that hold their wanted ranks, each cell cut between its extremes."""
    group = [*keys, "_bin", "_from"]
    wide = settle(cells.withColumnRenamed("_low", "_from").withColumnRenamed("_high", "_to"))
    share = (F.col("value") - F.col("_from")) / (F.col("_to") - F.col("_from"))
    pieces = (
        _joined(values, wide.select(*group, "_to"), [*keys, "_bin"])
        .where("value BETWEEN _from AND _to")
        .groupBy(*group, F.least(F.floor(share * FAN), F.lit(FAN - 1)).alias("_piece"))
        .agg(
            F.count(F.lit(1)).alias("_load"),
            F.sum("_w").alias("_own"),
            F.min("value").alias("_low"),
            F.max("value").alias("_high"),
        )
    )
    upto = (
        f"sum(_own) OVER (PARTITION BY {', '.join(group)} ORDER BY _piece "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    placed = pieces.selectExpr("*", f"{upto} AS _upto").join(wide.drop("_to", "_load"), group)
    return settle(
        placed.selectExpr(
            *keys, "_bin", "_low", "_high", "_load", "rows", "_before + _upto - _own AS _before",
            "filter(_wanted, w -> w.rank >= _before + _upto - _own AND w.rank < _before + _upto) AS _wanted",
        ).where("size(_wanted) > 0")
    )


def quantiles_at(
    located: DataFrame, values: DataFrame, probs: Sequence[float], keys: Sequence[str], budget: int = BUDGET
) -> DataFrame:
    """``keys, rows, q0..qk`` from the located bins and the distinct values in those of several values."""
    cells = located.withColumnRenamed("_n", "_load")
    columns = [*keys, "_bin", "_low", "_high", "_load", "rows", "_before", "_wanted"]
    known = cells.where("_low = _high").select(*columns)
    cells = cells.where("_low < _high").select(*columns)
    while (cells.agg(F.max("_load")).first()[0] or 0) > budget:
        cut = _cut(values, cells.where(F.col("_load") > budget), keys)
        known = known.unionAll(cut.where("_low = _high").select(*columns))
        rest = cells.where(F.col("_load") <= budget)
        cells = settle(rest.unionAll(cut.where("_low < _high").select(*columns)))
    group = ", ".join([*keys, "_bin", "_low"])
    picked = (
        _joined(values, cells, [*keys, "_bin"])
        .where("value BETWEEN _low AND _high")
        .selectExpr(
            *keys, "rows", "value", "_w", "_wanted",
            f"_before + sum(_w) OVER (PARTITION BY {group} ORDER BY value "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _end",
        )
        .selectExpr(
            *keys, "rows", "value",
            "explode(filter(_wanted, w -> w.rank >= _end - _w AND w.rank < _end)) AS w",
        )
    )
    found = picked.unionAll(known.selectExpr(*keys, "rows", "_low AS value", "explode(_wanted) AS w"))

    def interpolated(i: int) -> Column:
        low = f"max(value) FILTER (WHERE w.which = {i} AND w.side = 0)"
        high = f"max(value) FILTER (WHERE w.which = {i} AND w.side = 1)"
        part = f"max(w.part) FILTER (WHERE w.which = {i})"
        return F.expr(f"{low} + ({high} - {low}) * {part}").alias(f"q{i}")

    return found.groupBy(*keys).agg(
        F.max("rows").alias("rows"), *[interpolated(i) for i in range(len(probs))]
    )


def exact_quantiles(
    df: DataFrame,
    value: Column | str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    few_values: bool = False,
    budget: int = BUDGET,
) -> DataFrame:
    """``keys, rows, q0..qk``; linear interpolation between neighbours.

    ``few_values=True`` promises that the column has a small domain by its
    meaning (days, ratings), so a per-group count map stays small. Otherwise
    ``df`` is read twice, the second time only for the bins that hold wanted ranks,
    and no task sorts more than ``budget`` distinct values.
    """
    keys = list(keys)
    if few_values:
        return _few_quantiles(value_table(df, value, keys), probs, keys)
    rows = binned(df, value, keys)
    located = locate(bin_table(rows, keys), probs, keys)
    return quantiles_at(located, values_in(rows, _several(located, keys), keys), probs, keys, budget)


def _several(located: DataFrame, keys: Sequence[str]) -> DataFrame:
    return located.where("_low < _high").select(*keys, "_bin")


def _few_quantiles(counted: DataFrame, probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    together = counted.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.percentile("value", [float(p) for p in probs], F.col("n")).alias("_q"),
    )
    return together.select(
        *keys, "rows", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))]
    )


def approximate_quantiles(
    df: DataFrame,
    value: Column | str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """One-pass alternative with rank error at most ``1/accuracy``."""
    amount = as_column(value).cast("double")
    together = (
        with_keys(df, *keys)
        .groupBy(*keys)
        .agg(
            F.count(amount).alias("rows"),
            F.percentile_approx(amount, [float(p) for p in probs], accuracy).alias("_q"),
        )
    )
    return together.select(
        *keys, "rows", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))]
    )


def quantile_scalar(df: DataFrame, value: Column | str, prob: float) -> Column:
    """One quantile of the whole table, computed now, as a constant that filters can push down."""
    return F.lit(exact_quantiles(df, value, [prob]).first().q0).cast("double")


def fill_with_median(df: DataFrame, column: str) -> DataFrame:
    """Missing values take the exact median of the present ones."""
    return df.withColumn(column, F.coalesce(F.col(column), quantile_scalar(df, column, 0.5)))


def trim_above(df: DataFrame, value: str, prob: float) -> DataFrame:
    """Rows with ``0 < value < quantile(prob)``."""
    limit = quantile_scalar(df, value, prob)
    return df.where((F.col(value) > 0) & (F.col(value).cast("double") < limit))


def box_stats(
    df: DataFrame,
    value: Column | str,
    keys: Sequence[str] = (),
    few_values: bool = False,
    whisker: float = 1.5,
) -> DataFrame:
    """Quartiles, whiskers (furthest points within 1.5 IQR) and outlier count per group.

    Bounds of the quartiles, and so of the fences, follow from the bin counts. The second
    read takes the bins that hold a quartile or may hold a fence; every other bin is wholly
    inside or outside, and its count and extremes say all that is needed.
    """
    keys = list(keys)
    probs = [0.25, 0.5, 0.75]
    if few_values:
        counted = settle(value_table(df, value, keys))
        quartiles = _few_quantiles(counted, probs, keys)
        parts = counted.select(*keys, F.col("value").alias("_low"), F.col("value").alias("_high"), F.col("n").alias("_n"))
    else:
        rows = binned(df, value, keys)
        table = bin_table(rows, keys)
        located = locate(table, probs, keys)
        bins = _bins_at_edges(table, located, keys, whisker)
        values = values_in(rows, bins, keys)
        quartiles = quantiles_at(located, values, probs, keys)
        others = table.where("_n > 0").join(bins, [*keys, "_bin"], "left_anti")
        parts = others.select(*keys, "_low", "_high", "_n").unionAll(
            values.selectExpr(*keys, "value AS _low", "value AS _high", "_w AS _n")
        )
    if keys:
        placed = attach(parts, quartiles, keys, "rows")
    else:
        one = quartiles.first()
        placed = parts.withColumns({f"q{i}": F.lit(one[f"q{i}"]).cast("double") for i in range(3)})
    iqr = F.col("q2") - F.col("q0")
    within = (F.col("_low") >= F.col("q0") - whisker * iqr) & (
        F.col("_high") <= F.col("q2") + whisker * iqr
    )
    return placed.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows"),
        F.min("_low").alias("minimum"),
        F.min(F.when(within, F.col("_low"))).alias("whisker_low"),
        F.max("q0").alias("q1"),
        F.max("q1").alias("median"),
        F.max("q2").alias("q3"),
        F.max(F.when(within, F.col("_high"))).alias("whisker_high"),
        F.max("_high").alias("maximum"),
        F.coalesce(F.sum(F.when(~within, F.col("_n"))), F.lit(0)).cast("bigint").alias("outliers"),
    )


def _bins_at_edges(table: DataFrame, located: DataFrame, keys: Sequence[str], whisker: float) -> DataFrame:
    """``keys, _bin`` of the bins of several values that hold a quartile or may hold a fence."""

    def least(which: int) -> str:
        return f"min(_low) FILTER (WHERE w.which = {which})"

    def most(which: int) -> str:
        return f"max(_high) FILTER (WHERE w.which = {which})"

    bounds = located.selectExpr(*keys, "_low", "_high", "explode(_wanted) AS w").groupBy(*keys).agg(
        F.expr(least(0)).alias("_a"), F.expr(most(0)).alias("_b"),
        F.expr(least(2)).alias("_c"), F.expr(most(2)).alias("_d"),
    )
    # Quartiles lie in [a, b] and [c, d], so the fences lie between these.
    fences = bounds.selectExpr(
        *keys, f"_a - {whisker} * (_d - _a) AS _a", f"_b - {whisker} * (_c - _b) AS _b",
        f"_c + {whisker} * (_c - _b) AS _c", f"_d + {whisker} * (_d - _a) AS _d",
    )
    wide = table.where("_low < _high")
    if keys:
        near = wide.join(fences, list(keys))
    else:
        near = wide.join(F.broadcast(fences))
    near = near.where("(_low <= _b AND _high >= _a) OR (_low <= _d AND _high >= _c)")
    return settle(near.select(*keys, "_bin").union(_several(located, keys)).distinct())


def merged_moments(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, _weight`` (all rows), ``count, mean, std, min, max`` from a bin table with moments."""
    centred = _centred(table, keys)
    deviations = F.sum(F.col("_m2") + F.col("_n") * F.pow(F.col("_mean") - F.col("_centre"), F.lit(2)))
    return centred.groupBy(*keys).agg(
        F.sum("_all").alias("_weight"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("count"),
        ratio(F.sum("_total"), F.sum("_n")).alias("mean"),
        F.sqrt(ratio(deviations, F.sum("_n") - 1)).alias("std"),
        F.min("_low").alias("min"),
        F.max("_high").alias("max"),
    )


def _centred(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bins with the mean of their group (a few thousand bins at most)."""
    in_keys = ", ".join(keys) or "0"
    over = f"OVER (PARTITION BY {in_keys})"
    return table.selectExpr("*", f"try_divide(sum(_n * _mean) {over}, sum(_n) {over}) AS _centre")


def describe(df: DataFrame, value: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of one column, in two reads."""
    keys, probs = list(keys), [0.25, 0.5, 0.75]
    rows = binned(df, value, keys)
    table = bin_table(rows, keys, moments=True)
    located = locate(table, probs, keys)
    quartiles = quantiles_at(located, values_in(rows, _several(located, keys), keys), probs, keys)
    named = [F.col(f"q{i}").alias(name) for i, name in enumerate(("q25", "q50", "q75"))]
    moments = merged_moments(table, keys)
    order = [*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    if keys:
        return moments.join(quartiles.select(*keys, *named), keys, "left").select(*order)
    one = quartiles.select(*named).first()
    return moments.withColumns({c: F.lit(one[c]).cast("double") for c in ("q25", "q50", "q75")}).select(*order)
