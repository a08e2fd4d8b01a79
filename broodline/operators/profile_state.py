"""A table's profile as rows that can be stored, added to and merged.

One scan gives one row for each column (and part of the table, if parts are named):
counts of rows and missing values, the least and greatest value, and three sketches,
of the distinct values (theta), of the values themselves (frequent items) and of
their distribution (KLL). Rows of two states merge to the row of both tables, so new
days or partitions are profiled alone and added.

What is exact: the counts, extremes, the number of distinct values as long as it is
below ``EXACT``, and the values of a column with fewer than half of ``ITEMS``. A
theta sketch holds all hashes up to its nominal size, so an estimate below that is
a count, and one above it never falls below; with as few values the table of
frequent items has never dropped any. Beyond, distinct counts are estimates, and
quantiles always are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.functions.numeric import nan_as_null

#: Distinct values are counted exactly below this, a power of two.
EXACT_BITS = 12
EXACT = 1 << EXACT_BITS
#: Places for frequent items, three quarters of which are used before any is dropped.
ITEMS = 128

STATE = ["position", "column", "type", "rows", "missing", "least", "greatest", "distinct", "items", "levels"]


def theta_count(value: Column, bits: int = EXACT_BITS) -> Column:
    """Distinct values: exact below ``2 ** bits``, and at least that where there are more."""
    return F.theta_sketch_estimate(F.theta_sketch_agg(value, bits))


def profile_state(df: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """``parts.., position, column, type, rows, missing, least, greatest, distinct, items, levels``.

    NaN counts as missing. ``least`` and ``greatest`` are texts of the values,
    NULL for columns that have no order (maps). No row is moved: tasks send one
    row of sketches for each part they have seen. Parts must not be named like a
    column of the result.
    """
    if clash := set(parts) & set(STATE):
        raise ValueError(f"rename the part columns {sorted(clash)}")
    facts, columns = [], [f for f in df.schema if f.name not in parts]
    for place, f in enumerate(columns):
        value = _present(f)
        text = value.cast("string") if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(value)
        ordered = not isinstance(f.dataType, (T.MapType, T.VariantType))
        number = isinstance(f.dataType, T.NumericType)
        none = F.lit(None)
        facts.append(
            F.struct(
                F.lit(place).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(value.isNull()).alias("missing"),
                (F.min(value).cast("string") if ordered else none.cast("string")).alias("least"),
                (F.max(value).cast("string") if ordered else none.cast("string")).alias("greatest"),
                F.theta_sketch_agg(text, EXACT_BITS).alias("distinct"),
                _kept_items(text).alias("items"),
                (F.kll_sketch_agg_double(value.cast("double")) if number else none.cast("binary")).alias("levels"),
            )
        )
    grouped = df.groupBy(*[F.col(f"`{p}`") for p in parts]).agg(F.array(*facts).alias("__facts"))
    return grouped.select(*[F.col(f"`{p}`") for p in parts], F.inline("__facts"))


def merge_states(state: DataFrame) -> DataFrame:
    """One row for each column, of all parts together."""
    number = F.first("type", ignorenulls=True)
    smaller, greater = _extreme("least", F.min_by), _extreme("greatest", F.max_by)
    return state.groupBy("column").agg(
        F.min("position").alias("position"),
        number.alias("type"),
        F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"),
        smaller.alias("least"),
        greater.alias("greatest"),
        F.theta_union_agg("distinct", F.lit(EXACT_BITS)).alias("distinct"),
        F.expr("approx_top_k_combine(items)").alias("items"),
        F.kll_merge_agg_double("levels").alias("levels"),
    )


def state_report(merged: DataFrame, below: int = 13, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``position, column, type, row_count, null_count, null_pct, n_distinct, is_exact, listing, least, greatest, quantiles``.

    ``listing`` has the values, ascending and joined by ``', '``, of columns with
    fewer than ``below`` of them, else NULL.
    """
    if 2 * below > ITEMS:
        raise ValueError(f"at most {ITEMS // 2} values can be listed")
    count = F.theta_sketch_estimate("distinct")
    kept = F.expr(f"approx_top_k_estimate(items, {ITEMS // 2})")
    values = F.array_sort(F.filter(F.transform(kept, lambda i: i["item"]), lambda v: v.isNotNull()))
    levels = F.array(*[F.kll_sketch_get_quantile_double("levels", F.lit(float(q))) for q in quantiles])
    has_levels = F.kll_sketch_get_n_double("levels") > 0
    return merged.select(
        "position",
        "column",
        "type",
        F.col("rows").alias("row_count"),
        F.col("missing").alias("null_count"),
        F.round(F.try_divide("missing", "rows") * 100, 3).alias("null_pct"),
        count.alias("n_distinct"),
        (count < EXACT).alias("is_exact"),
        F.when((count < below) & (count > 0), F.array_join(values, ", ")).alias("listing"),
        "least",
        "greatest",
        F.when(has_levels, levels).alias("quantiles"),
    )


def _kept_items(text: Column) -> Column:
    return F.call_function("approx_top_k_accumulate", text, F.lit(ITEMS))


def _extreme(name: str, pick) -> Column:
    """The least or greatest of the stored texts, in the order of the column's type."""
    whole = F.col("type").isin("tinyint", "smallint", "int", "bigint") | F.col("type").startswith("decimal")
    real = F.col("type").isin("float", "double")
    key = F.struct(
        F.when(whole, F.col(name).try_cast("decimal(38,10)")).alias("whole"),
        F.when(real, F.col(name).try_cast("double")).alias("real"),
        F.when(~whole & ~real, F.col(name)).alias("other"),
    )
    return pick(F.col(name), F.when(F.col(name).isNotNull(), key))


def _present(f: T.StructField) -> Column:
    value = F.col(f"`{f.name}`")
    return nan_as_null(value) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else value
