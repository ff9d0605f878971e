"""Connected components of a graph given as edges, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import stage
from orderlens.operators.settle import release

# Up to so many edges the table of minima (two numbers each) is broadcast.
BROADCAST_EDGES = 500_000


def roots(edges: DataFrame) -> DataFrame:
    """node, root for every node that is not the smallest of its component.

    ``edges`` has two bigint columns. Every round is written to the shared folder;
    rounds end when the edges do not change any more, and their number grows with
    the logarithm of the component's width. Minima are combined before they are
    shuffled, so a node with very many neighbours is no hot group.
    """
    a, b = edges.columns
    state = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    mark = _mark(state)
    while mark[0]:
        few = mark[0] <= BROADCAST_EDGES
        both = state.select("u", "v").unionAll(state.select(F.col("v"), F.col("u")))
        lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            state.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(F.broadcast(lowest) if few else lowest, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = stage(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(F.broadcast(lowest) if few else lowest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct()
        following = stage(small)
        now = _mark(following)
        release(large)
        release(state)
        state = following
        if now == mark:
            break
        mark = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
            F.bit_xor(F.xxhash64("v", "u")),
        ).first()
    )
