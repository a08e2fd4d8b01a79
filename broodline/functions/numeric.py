"""Guarded arithmetic and banding of numeric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broodline.functions.text import as_column

# Age bands as (label, last day); older than the last is OLDEST_BAND.
AGE_BANDS = [("w1", 7), ("w2", 14), ("w3", 21), ("w4", 28), ("w5", 35)]
OLDEST_BAND = "w6"

# Price band labels. The first label starts with a blank.
PRICE_BANDS = [
    " < 2000",
    "2000 - 4000",
    "4000 - 6000",
    "6000 - 8000",
    "8000 - 10000",
    "10000 - 12000",
    "> 12000",
]


def zero_guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0, NULL where it is NULL, the ratio elsewhere."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(F.try_divide(numerator, denominator))


def nan_as_null(value: Column | str) -> Column:
    """A floating-point value, NULL where it is NaN."""
    column = as_column(value)
    return F.when(~F.isnan(column), column)


def or_zero(value: Column | str) -> Column:
    return F.coalesce(as_column(value), F.lit(0))


def age_band(age: Column | str) -> Column:
    """Week band of an age in days; NULL age has no band."""
    days = as_column(age)
    label, last_day = AGE_BANDS[0]
    band = F.when(days <= last_day, F.lit(label))
    for label, last_day in AGE_BANDS[1:]:
        band = band.when(days <= last_day, F.lit(label))
    return band.when(days.isNotNull(), F.lit(OLDEST_BAND))


def price_band(price: Column | str) -> Column:
    """Price band; bands are 2000 wide and only the 12000 edge belongs to the lower one."""
    amount = as_column(price)
    band = F.when(amount < 2000, F.lit(PRICE_BANDS[0]))
    for step, label in enumerate(PRICE_BANDS[1:5], start=2):
        band = band.when(amount < 2000 * step, F.lit(label))
    return band.when(amount <= 12000, F.lit(PRICE_BANDS[5])).when(
        amount > 12000, F.lit(PRICE_BANDS[6])
    )


def used_flag(amount: Column | str) -> Column:
    """1 when the amount is exactly 1 or at least 2, else 0 (also for NULL and 1 < x < 2)."""
    x = as_column(amount)
    return F.when((x == 1) | (x >= 2), 1).otherwise(0)


def growth_rate(later: Column | str, earlier: Column | str, digits: int = 1) -> Column:
    """Rounded ratio of two weights; NULL where the earlier one is 0 or missing."""
    return F.round(F.try_divide(as_column(later), as_column(earlier)), digits)


def percent(fraction: Column | str, digits: int = 4) -> Column:
    return F.round(as_column(fraction) * 100, digits)
