"""Table profile as a DataFrame of facts: counts, duplicates, NULLs, small domains.

The whole report takes two scans: one for the duplicates, one for all other facts
(``profile_state``). Listed alone, distinct values are counted only for columns that
pass the threshold: a theta sketch of at least that size counts exactly up to it and
never reports fewer values than it holds, so the choice is the one an exact count
would make, and wide or unique columns (whole texts, ids) stay out of the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.operators.profile_state import merge_states, profile_state, state_report, theta_count

# Fixed value: text columns with fewer distinct values than this are listed.
SMALL_DOMAIN = 13


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def duplicate_rows(df: DataFrame, digest: bool = False) -> DataFrame:
    """``(row_count, duplicate_rows, duplicate_pct)``: rows beyond the first of each kind.

    NULLs count as equal. Copies are folded on the map side. ``digest`` groups by
    the SHA-256 of the row instead of the row, for tables whose rows are too wide
    to shuffle.
    """
    columns = [F.sha2(_row_text(df), 256)] if digest else [_column(c) for c in df.columns]
    groups = df.groupBy(*columns)
    return (
        groups.agg(F.count(F.lit(1)).alias("__n"))
        .agg(
            F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
        .withColumn("duplicate_pct", _share("duplicate_rows", "row_count", 1))
    )


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, null_count, null_pct)`` for the columns that contain NULLs; NaN counts as NULL."""
    missing = [
        F.count_if(_is_missing(f)).alias(f"__null_{i}") for i, f in enumerate(df.schema)
    ]
    facts = F.array(
        *[
            F.struct(F.lit(name).alias("column"), F.col(f"__null_{i}").alias("null_count"))
            for i, name in enumerate(df.columns)
        ]
    )
    return (
        df.agg(F.count(F.lit(1)).alias("__rows"), *missing)
        .select("__rows", F.inline(facts))
        .where(F.col("null_count") > 0)
        .select("column", "null_count", _share("null_count", "__rows", 3).alias("null_pct"))
    )


def small_domains(df: DataFrame, below: Mapping[str, int]) -> DataFrame:
    """``(column, n_distinct, values)`` of columns with fewer distinct values than given.

    NULL is not a value. ``values`` is the ascending list joined by ``', '``.
    """
    if not below:
        return df.sparkSession.createDataFrame(
            [], "column string, n_distinct bigint, values string"
        )
    estimates = [
        F.when(theta_count(_column(name).cast("string"), max(4, limit.bit_length())) < limit, F.lit(name))
        for name, limit in below.items()
    ]
    candidates = df.agg(F.array_compact(F.array(*estimates)).alias("c")).scalar()
    cells = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(limit).alias("below"),
            F.when(F.array_contains(candidates, F.lit(name)), _column(name).cast("string")).alias(
                "value"
            ),
        )
        for name, limit in below.items()
    ]
    return (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "below", "value")
        .count()
        .groupBy("column", "below")
        .agg(
            F.count("value").alias("n_distinct"),
            F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("values"),
        )
        .where(F.col("n_distinct") < F.col("below"))
        .drop("below")
    )


def low_cardinality(df: DataFrame, below: int = SMALL_DOMAIN) -> DataFrame:
    """Text columns with a small domain and their values."""
    return small_domains(df, dict.fromkeys(text_columns(df), below))


def boolean_candidates(df: DataFrame) -> DataFrame:
    """Numeric columns with exactly two distinct values."""
    return small_domains(df, dict.fromkeys(numeric_columns(df), 3)).where(F.col("n_distinct") == 2)


def profile(df: DataFrame, digest: bool = True) -> DataFrame:
    """The whole report as ``(section, column, metric, value, listing)`` rows."""
    whole = duplicate_rows(df, digest).select(
        F.inline(
            F.array(
                _fact("table", "row_count", F.col("row_count")),
                _fact("table", "column_count", F.lit(len(df.columns))),
                _fact("table", "duplicate_rows", F.col("duplicate_rows")),
                _fact("table", "duplicate_pct", F.col("duplicate_pct")),
            )
        )
    )
    column = F.col("column")
    texts, numbers = text_columns(df), numeric_columns(df)
    report = state_report(merge_states(profile_state(df)), SMALL_DOMAIN)
    is_text = column.isin(texts)
    section = F.when(is_text, "low_cardinality").otherwise("boolean_candidates")
    shown = F.col("listing").isNotNull() & (is_text | (column.isin(numbers) & (F.col("n_distinct") == 2)))
    facts = F.array_compact(
        F.array(
            F.when(F.col("null_count") > 0, _fact("nulls", "null_count", F.col("null_count"), column)),
            F.when(F.col("null_count") > 0, _fact("nulls", "null_pct", F.col("null_pct"), column)),
            F.when(shown, _fact(section, "n_distinct", F.col("n_distinct"), column, F.col("listing"))),
        )
    )
    return whole.unionByName(report.select(F.inline(facts)))


def _fact(
    section: str | Column,
    metric: str,
    value: Column,
    column: Column | None = None,
    listing: Column | None = None,
) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        (F.lit(section) if isinstance(section, str) else section).alias("section"),
        (nothing if column is None else column).alias("column"),
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
        (nothing if listing is None else listing).alias("listing"),
    )


def _row_text(df: DataFrame) -> Column:
    """The row as text that differs whenever any value (or NULL) differs."""
    parts = []
    for f in df.schema:
        value = _column(f.name)
        if isinstance(f.dataType, T.BinaryType):
            text = F.hex(value)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            text = F.to_json(value, {"ignoreNullFields": "false"})
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            text = (value + 0.0).cast("string")  # -0.0 and 0.0 are equal
        else:
            text = value.cast("string")
        marked = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(marked, F.lit("-")))
    return F.concat(*parts)


def _is_missing(f: T.StructField) -> Column:
    missing = _column(f.name).isNull()
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        missing = missing | F.isnan(_column(f.name))
    return missing


def _share(part: str, whole: str, digits: int) -> Column:
    return F.round(F.try_divide(F.col(part), F.col(whole)) * 100, digits)


def _column(name: str) -> Column:
    return F.col(f"`{name}`")
