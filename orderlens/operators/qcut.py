"""Quantile binning, by value and by rank, without sorting the table in one task."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.operators.quantiles import exact_quantiles, value_bin
from orderlens.operators.settle import stage

# One task sorts at most so many rows; a fuller piece of the order is cut by so many splitters.
BUDGET = 500_000
SPLITTERS = 64


@dataclass(frozen=True)
class Cut:
    """How to bin one column.

    Without ``tie`` the bins follow the values: edges are quantiles, closed on the
    right, and equal edges collapse (there may be fewer labels than ``bins``, and
    none when all edges coincide). With ``tie``, a unique column, rows are ranked
    by (value, tie) and the bins are of equal size: row r of n falls in bin
    ``max(1, ceil((r - 1) * bins / (n - 1)))``.

    ``descending`` gives the smallest values the highest label. ``few_values``
    promises a small domain (days, counts of a bounded thing).
    """

    value: str
    tie: str | None = None
    bins: int = 5
    descending: bool = False
    few_values: bool = False


def qcut(df: DataFrame, **cuts: Cut) -> DataFrame:
    """Add one integer column per cut.

    ``df`` (as a rule one row per customer) is computed once and kept in the shared folder;
    the limits of the bins are found on that copy and enter the result as constants.
    """
    kept = stage(df)
    limits = {
        name: _rank_limits(kept, cut) if cut.tie else _value_edges(kept, cut)
        for name, cut in cuts.items()
    }
    return kept.select("*", *[_label(cut, limits[name]).alias(name) for name, cut in cuts.items()])


def _label(cut: Cut, limits: tuple[list[Column], int]) -> Column:
    """How many inner limits lie below the row, counted from 1; null without bins or a value."""
    inner, most = limits
    if cut.tie:
        position = F.struct(F.col(cut.value).alias("v"), F.col(cut.tie).alias("t"))
    else:
        position = F.col(cut.value).cast("double")
    label = F.lit(1)
    for limit in inner:
        label = label + (limit < position).cast("int")
    if cut.descending:
        label = F.lit(most + 1) - label
    return F.when(F.lit(most >= 1) & F.col(cut.value).isNotNull(), label).cast("int")


def _value_edges(df: DataFrame, cut: Cut) -> tuple[list[Column], int]:
    probs = [i / cut.bins for i in range(cut.bins + 1)]
    row = exact_quantiles(df, cut.value, probs, (), cut.few_values).first()
    edges = sorted({row[f"q{i}"] for i in range(cut.bins + 1)} - {None})
    return [F.lit(edge).cast("double") for edge in edges[1:-1]], len(edges) - 1


@dataclass(frozen=True)
class _Piece:
    """A piece of the order (value, tie): which rows, how many, and the wanted ranks within it (from 1)."""

    rows: Column
    count: int
    ranks: tuple[int, ...]


def _rank_limits(df: DataFrame, cut: Cut) -> tuple[list[Column], int]:
    """The rows at which the bins of a global ranking end.

    Coarse bins of the value (their number does not grow with the data) are counted, which
    tells the pieces of the order that hold a wanted rank. A piece of more rows than one
    task should sort is cut by splitters, its rows with the smallest hash of their id, and
    counted again, as often as needed: the depth grows with the logarithm of the piece.
    Splitters are data, so a lost task that is repeated finds the same pieces.
    """
    position = F.struct(F.col(cut.value).alias("v"), F.col(cut.tie).alias("t"))
    keyed = df.where(F.col(cut.value).isNotNull()).select(
        position.alias("key"), value_bin(F.col(cut.value).cast("double")).alias("bin")
    )
    kind = keyed.schema["key"].dataType
    counts = sorted(tuple(r) for r in keyed.groupBy("bin").count().collect())
    total = sum(count for _, count in counts)
    wanted = [k * (total - 1) // cut.bins + 1 for k in range(1, cut.bins)] if total else []
    whole = _Piece(F.lit(True), total, tuple(wanted))
    pieces = _holding(whole, [(F.col("bin") == value, count) for value, count in counts])
    while any(piece.count > BUDGET for piece in pieces):
        pieces = [
            part
            for piece in pieces
            for part in ([piece] if piece.count <= BUDGET else _split(keyed, piece, kind))
        ]
    if not pieces:
        return [], cut.bins
    # At most bins - 1 pieces are left, each within the budget; they are told apart by number.
    number = F.coalesce(*[F.when(piece.rows, F.lit(i)) for i, piece in enumerate(pieces)])
    ranks = F.array(*[F.array(*[F.lit(r) for r in piece.ranks]) for piece in pieces])
    order = Window.partitionBy("piece").orderBy("key")
    found = (
        keyed.withColumn("piece", number)
        .where("piece IS NOT NULL")
        .withColumn("at", F.row_number().over(order))
        .where(F.array_contains(F.get(ranks, F.col("piece")), F.col("at")))
        .select("piece", "at", "key")
        .collect()
    )
    ends = {(r.piece, r.at): r.key for r in found}
    inner = [ends[i, rank] for i, piece in enumerate(pieces) for rank in piece.ranks]
    return [_constant(key, kind) for key in inner], cut.bins


def _constant(key, kind) -> Column:
    return F.struct(*[F.lit(key[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])


def _holding(piece: _Piece, parts: list[tuple[Column, int]]) -> list[_Piece]:
    """Those parts of a piece (in order, with their counts) that hold wanted ranks."""
    found, before = [], 0
    for rows, count in parts:
        ranks = tuple(r - before for r in piece.ranks if before < r <= before + count)
        if ranks:
            found.append(replace(piece, rows=piece.rows & rows, count=count, ranks=ranks))
        before += count
    return found


def _split(keyed: DataFrame, piece: _Piece, kind) -> list[_Piece]:
    """The parts of a piece that hold its wanted ranks, between splitters."""
    own = keyed.where(piece.rows)
    chosen = own.orderBy(F.xxhash64("key.t"), "key.t").limit(SPLITTERS).orderBy("key").collect()
    limits = [_constant(r.key, kind) for r in chosen]
    place = F.size(F.filter(F.array(*limits), lambda limit: limit < F.col("key")))
    counts = dict(own.groupBy(place.alias("place")).count().collect())
    key = F.col("key")
    edges = [None, *limits, None]
    parts = []
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        above = F.lit(True) if low is None else key > low
        parts.append((above if high is None else above & (key <= high), counts.get(i, 0)))
    return _holding(piece, parts)
