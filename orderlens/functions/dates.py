"""Date parsing and calendar arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A date written with the year last, and where its parts go in ISO order.
YEAR_LAST_PATTERN = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?!\d)"
DAY_FIRST, MONTH_FIRST = "$3-$2-$1", "$3-$1-$2"


def parse_date(text: Column, day_first: bool = True, formats: Sequence[str] = ()) -> Column:
    """Date from yyyy-mm-dd, dd/mm/yyyy or dd-mm-yyyy text (a time of day may follow), else NULL.

    The text is put into ISO order and cast; unlike trying one format after the
    other this raises no exception inside the engine for rows in another format.
    Further ``formats`` are tried, in order, on rows that are still without a date.
    """
    order = DAY_FIRST if day_first else MONTH_FIRST
    iso = F.regexp_replace(F.trim(text), YEAR_LAST_PATTERN, order)
    return F.coalesce(iso.try_cast("date"), *[F.try_to_date(F.trim(text), f) for f in formats])


def calendar_columns(date: Column) -> dict[str, Column]:
    return {
        "order_year": F.year(date),
        "order_month": F.month(date),
        "order_quarter": F.quarter(date),
    }


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_name(month: Column) -> Column:
    """1..12 to Jan..Dec."""
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")


def month_number(date: Column) -> Column:
    """Months since year 0: differences count calendar months, ignoring the day."""
    return F.year(date) * 12 + F.month(date)


def calendar_months_between(later: Column, earlier: Column) -> Column:
    return month_number(later) - month_number(earlier)
