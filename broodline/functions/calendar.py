"""Calendar buckets: ISO week and year, month abbreviation, week of the month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broodline.functions.text import as_column

# Month abbreviations used in bucket labels.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def week_of_month(day: Column | str) -> Column:
    """Week row of the date on a Monday-first month sheet, 1 to 6."""
    date = as_column(day)
    lead = F.weekday(F.trunc(date, "MONTH"))
    return F.ceil((F.dayofmonth(date) + lead) / F.lit(7.0)).cast("int")


def iso_week(day: Column | str) -> Column:
    return F.weekofyear(as_column(day))


def iso_year(day: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), as_column(day)).cast("int")


def month_abbreviation(day: Column | str) -> Column:
    return F.substr(F.lit("".join(MONTHS)), F.month(as_column(day)) * 3 - 2, F.lit(3))


def calendar_parts(day: Column | str, year_mode: str = "iso") -> dict[str, Column]:
    """Bucket columns for ``withColumns``.

    ``year_mode="iso"`` pairs the ISO year with the calendar month, so 1 January
    2022 falls into January **2021**; ``"calendar"`` uses the plain year.
    """
    if year_mode not in ("iso", "calendar"):
        raise ValueError(f"year_mode must be 'iso' or 'calendar', not {year_mode!r}")
    date = as_column(day)
    return {
        "week": iso_week(date),
        "month": month_abbreviation(date),
        "year": iso_year(date) if year_mode == "iso" else F.year(date),
        "week_of_month": week_of_month(date),
    }


def bucket_label(month: Column | str, year: Column | str, week: Column | str) -> Column:
    """Report heading such as ``Jan 21 : week 1``."""
    short_year = F.lpad((as_column(year) % 100).cast("string"), 2, "0")
    return F.concat(
        as_column(month), F.lit(" "), short_year, F.lit(" : week "), as_column(week).cast("string")
    )


def bucket_headings(years: list[int], max_week: int = 6, skip: int = 0) -> list[str]:
    """Every heading of a report grid in calendar order, minus the first ``skip``."""
    grid = [
        f"{month} {year % 100:02d} : week {week}"
        for year in years
        for month in MONTHS
        for week in range(1, max_week + 1)
    ]
    return grid[skip:]
