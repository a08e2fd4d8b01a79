"""Optional row filters.

Each bound or value list is applied only when it is given, so an unset parameter
leaves no trace in the plan and a set one is a plain predicate that Catalyst can
push to the scan and through windows partitioned by the filtered column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_range(df: DataFrame, column: str, lower: Any = None, upper: Any = None) -> DataFrame:
    """Keep rows with ``lower <= column <= upper``; a None bound is open."""
    if lower is not None:
        df = df.where(F.col(column) >= F.lit(lower))
    if upper is not None:
        df = df.where(F.col(column) <= F.lit(upper))
    return df


def one_of(df: DataFrame, choices: Mapping[str, Iterable[Any] | None]) -> DataFrame:
    """Keep rows whose columns hold one of the listed values; None skips a column."""
    for column, values in choices.items():
        if values is not None:
            df = df.where(F.col(column).isin(list(values)))
    return df


def last_n_days(
    df: DataFrame, column: str, days: int | None, as_of: dt.date | Column | None = None
) -> DataFrame:
    """Keep rows dated on or after ``as_of - days``; ``as_of`` defaults to today."""
    if days is None:
        return df
    if as_of is None:
        anchor = F.current_date()
    else:
        anchor = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.where(F.col(column) >= F.date_sub(anchor, days))
