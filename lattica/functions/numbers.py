"""Numeric guards shared by scans, bounds and encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed form of a number as text: sign, digits, fraction, exponent; blank is no number.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def finite(c: Column) -> Column:
    """True for finite numbers; Spark orders NaN above all, so comparisons alone don't drop it."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def number(c: Column, of_text: bool) -> Column:
    """The finite number that a value is or spells, else null."""
    if of_text:
        return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))
    return F.when(finite(c), c.cast("double"))


def or_nan(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float("nan")))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
