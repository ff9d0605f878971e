"""Fixed-edge bins, closed on the left and open on the right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: bin edges and labels --------------------------------------------
DISCOUNT_EDGES = (0, 10, 20, 30, 40, 50, 100)
DISCOUNT_LABELS = ("0-10%", "10-20%", "20-30%", "30-40%", "40-50%", "50%+")
PRICE_EDGES = (0, 500, 1000, 2000, 5000, 10000)
PRICE_LABELS = ("0-500", "500-1000", "1000-2000", "2000-5000", "5000-10000", "10000+")
# --------------------------------------------------------------------------------------


def fixed_bin(value: Column, edges: Sequence[Column | float], labels: Sequence[str]) -> Column:
    """Label of the bin ``[edge, next edge)`` holding ``value``; NULL outside all of them."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    chain = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels))):
        chain = F.when((value >= low) & (value < high), label).otherwise(chain)
    return chain


def discount_bin(percent: Column) -> Column:
    return fixed_bin(percent, DISCOUNT_EDGES, DISCOUNT_LABELS)


def price_bin(price: Column, highest: Column) -> Column:
    """The last bin ends (open) at ``highest``, the largest price in the data."""
    return fixed_bin(price, (*PRICE_EDGES, highest), PRICE_LABELS)
