"""Cleaning rules for free-text columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: aliases and words that decide the cleaned result ----------
CITY_ALIASES = {
    "bombay": "mumbai",
    "mumba": "mumbai",
    "bangalore": "bengaluru",
    "bengalore": "bengaluru",
    "banglore": "bengaluru",
    "calcutta": "kolkata",
    "chenai": "chennai",
    "madras": "chennai",
    "new delhi": "delhi",
    "delhi ncr": "delhi",
}
CATEGORY_ALIASES = {
    "electronic": "electronics",
    "electronicss": "electronics",
}
TRUE_WORDS = ("true", "yes", "y", "1")
FALSE_WORDS = ("false", "no", "n", "0")
PRICE_PATTERN = r"(\d[\d,]*\.?\d*)"
RATING_PATTERN = r"^([\d.]+)"
CURRENCY_CHARACTERS = ",₹"
# ------------------------------------------------------------------------------


def alias_map(text: Column, aliases: Mapping[str, str]) -> Column:
    """Replace known spellings, keep the rest."""
    pairs = [F.lit(part) for pair in aliases.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), text)


def title_case(text: Column) -> Column:
    """Capital after every non-letter (``initcap`` alone only looks at spaces)."""
    words = F.split(text, r"(?<=[^A-Za-z])")
    in_parts = F.array_join(F.transform(words, F.initcap), "")
    return F.when(text.rlike("[^A-Za-z ]"), in_parts).otherwise(F.initcap(text))


def normal_key(text: Column) -> Column:
    return F.lower(F.trim(text))


def clean_city(text: Column) -> Column:
    return title_case(alias_map(normal_key(text), CITY_ALIASES))


def clean_category(text: Column) -> Column:
    return title_case(alias_map(normal_key(text), CATEGORY_ALIASES))


def clean_flag(text: Column) -> Column:
    """Yes/no words to boolean, anything else to NULL."""
    word = normal_key(text)
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def flag_to_int(text: Column) -> Column:
    return clean_flag(text.cast("string")).cast("int")


def _first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def clean_price(text: Column, target: str = "decimal(18,2)") -> Column:
    """First number in the text without thousands commas, rounded half-even to 2 digits."""
    digits = F.regexp_replace(_first_match(text, PRICE_PATTERN), ",", "")
    return F.bround(digits.try_cast("decimal(24,6)"), 2).try_cast(target)


def plain_amount(text: Column, target: str = "decimal(18,2)") -> Column:
    """A written number, sign and exponent included, rounded half-even to 2 digits, else NULL."""
    return F.bround(F.trim(text.cast("string")).try_cast("decimal(24,6)"), 2).try_cast(target)


def plain_price(text: Column) -> Column:
    """Drop the currency sign and commas; NULL unless all that remains is a number."""
    return F.translate(text.cast("string"), CURRENCY_CHARACTERS, "").try_cast("double")


def clean_rating(text: Column) -> Column:
    """Leading number of texts like '4.5/5'; NULL when it is not one number."""
    return _first_match(text, RATING_PATTERN).try_cast("double")


def label_missing(text: Column, label: str) -> Column:
    return F.coalesce(text, F.lit(label))
