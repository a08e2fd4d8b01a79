"""Grouped sums, conditional pivots, indicator columns and row-wise column families."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broodline.functions.numeric import used_flag


def ratio_of_sums(numerator: Column | str, denominator: Column | str) -> Column:
    """Weighted mean such as price per kilogram; NULL when the weights sum to 0."""
    return F.try_divide(F.sum(numerator), F.sum(denominator))


def conditional_sums(
    value: Column | str, label: Column | str, outputs: Mapping[str, str]
) -> list[Column]:
    """One ``sum(value where label = key, else 0)`` per ``{label: output name}``."""
    tag = F.col(label) if isinstance(label, str) else label
    amount = F.col(value) if isinstance(value, str) else value
    return [
        F.sum(F.when(tag == key, amount).otherwise(0)).alias(name) for key, name in outputs.items()
    ]


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    """0/1 columns ``prefix_value`` for the given values."""
    return df.withColumns(
        {f"{prefix}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
    )


def frequent_values(df: DataFrame, column: str, most: int = 100) -> list[tuple[str, int]]:
    """At most ``most`` values with their exact counts, the most frequent first, ties by value.

    A sketch names candidates and a second scan counts these, so the driver sees no
    more than twice ``most`` values however many there are. With at most
    ``most`` values all are listed; beyond, each value that holds more than a
    ``most``-th of the rows is. NULL is no value.
    """
    places = 1 << (8 * most - 1).bit_length()
    text = F.col(f"`{column}`").cast("string")
    found = df.where(text.isNotNull()).agg(
        F.call_function("approx_top_k", text, F.lit(2 * most), F.lit(places)).alias("found")
    )
    names = [r["item"] for r in (found.first()[0] or [])]
    counted = df.where(text.isin(names)).groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.orderBy(F.desc("n"), "value").limit(most).collect()
    return [(r["value"], r["n"]) for r in rows]


def one_hot_found(
    df: DataFrame, column: str, keys: Sequence[str], prefix: str, most: int = 100
) -> tuple[DataFrame, DataFrame]:
    """0/1 columns for the values that are found, and the rows of all others in long form.

    The first table is ``df`` with a column ``prefix_value`` for each frequent value
    (see :func:`frequent_values`), by value, and ``prefix__rest``, 1 where the
    value has no column of its own. The second has ``keys`` and ``value`` of just
    these rows, so no value vanishes; it is empty where all have a column.
    """
    names = sorted(name for name, _ in frequent_values(df, column, most))
    text = F.col(f"`{column}`").cast("string")
    unlisted = text.isNotNull() & ~F.coalesce(text.isin(names), F.lit(False))
    flags = {f"{prefix}_{v}": F.coalesce((text == v).cast("int"), F.lit(0)) for v in names}
    wide = df.withColumns(flags | {f"{prefix}__rest": unlisted.cast("int")})
    return wide, df.where(unlisted).select(*keys, text.alias("value"))


def family_columns(columns: Iterable[str], days: Iterable[int]) -> dict[str, list[str]]:
    """Group ``{brand}_{day}`` and ``{phase}_{brand}_{day}`` columns by family.

    Names are parsed whole, so a brand whose name is part of another one does not
    absorb that one's columns. Keys are ``brand`` or ``phase_brand``.
    """
    wanted = set(days)
    families: dict[str, list[str]] = {}
    for name in columns:
        parsed = re.fullmatch(r"(.+)_(\d+)", name)
        if parsed and int(parsed[2]) in wanted:
            families.setdefault(parsed[1], []).append(name)
    return families


def brand_families(families: Mapping[str, list[str]], phases: Sequence[str]) -> list[str]:
    """The families that are plain brands, not brands within a phase."""
    heads = tuple(f"{phase}_" for phase in phases)
    return [family for family in families if not heads or not family.startswith(heads)]


def row_sum(names: Iterable[str]) -> Column:
    """Row-wise sum of the columns, NULL cells counting as 0.

    Built as one SQL text: wide tables have hundreds of such columns.
    """
    return F.expr(" + ".join(f"coalesce(`{name}`, 0)" for name in names))


def row_sums(families: Mapping[str, list[str]]) -> dict[str, Column]:
    return {family: row_sum(names) for family, names in families.items()}


def used_families(families: Mapping[str, list[str]]) -> Column:
    """Array of the family names whose row sum counts as used."""
    flags = [
        F.when(used_flag(row_sum(names)) == 1, F.lit(family)) for family, names in families.items()
    ]
    return F.array_compact(F.array(*flags))
