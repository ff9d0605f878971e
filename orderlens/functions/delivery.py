"""Two readings of the delivery-time text; callers choose one by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderlens.functions.text import normal_key

# ---- Fixed values ---------------------------------------------------------------
SAME_DAY_LABELS = ("same day", "express")
RANGE_PATTERN = r"^(\d+)-(\d+)"
NUMBER_PATTERN = r"(\d+)"
LONGEST_DELIVERY_DAYS = 30
EXPRESS_DAYS = 0.5
# ---------------------------------------------------------------------------------


def whole_days(text: Column) -> Column:
    """Whole days: a range becomes its rounded middle, values over 30 become NULL."""
    word = normal_key(text)
    low = F.regexp_extract(word, RANGE_PATTERN, 1).try_cast("double")
    high = F.regexp_extract(word, RANGE_PATTERN, 2).try_cast("double")
    single = F.regexp_extract(word, NUMBER_PATTERN, 1).try_cast("double")
    return (
        F.when(word.isin(*SAME_DAY_LABELS), 0.0)
        .when(word.rlike(RANGE_PATTERN), F.bround((low + high) / 2, 0))
        .when(single <= LONGEST_DELIVERY_DAYS, single)
    )


def average_days(text: Column) -> Column:
    """Mean of all numbers in the text; express counts half a day, negatives are NULL."""
    word = normal_key(text)
    numbers = F.transform(
        F.regexp_extract_all(word, F.lit(NUMBER_PATTERN), F.lit(1)),
        lambda digits: digits.cast("double"),
    )
    added = F.aggregate(numbers, F.lit(0.0), lambda acc, number: acc + number)
    return (
        F.when(word.contains("same"), 0.0)
        .when(word.contains("express"), EXPRESS_DAYS)
        .when(word.startswith("-"), None)
        .otherwise(F.try_divide(added, F.size(numbers).cast("double")))
    )
