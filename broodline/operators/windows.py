"""Ordered per-group metrics: differences, running sums, running means, ranks.

A production cycle is a few dozen days, so the plain window forms sort small
groups and several of them over the same keys share one exchange and one sort.
The ``blocked_*`` forms are for groups without such a bound (one key holding a
third of all rows): they cut every group into blocks along the order column,
compute inside the blocks in parallel and carry one summary row per block across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_age(keys: Sequence[str], order: str) -> WindowSpec:
    """Window over one group in ascending order, default RANGE frame."""
    return Window.partitionBy(*keys).orderBy(F.col(order).asc())


def delta(value: Column | str, window: WindowSpec) -> Column:
    """Difference to the previous row; NULL on the first row of the group."""
    column = F.col(value) if isinstance(value, str) else value
    return column - F.lag(column, 1).over(window)


def running_sum(value: Column | str, window: WindowSpec) -> Column:
    """Cumulative sum that includes rows tied on the order column."""
    return F.sum(value).over(window)


def running_mean_where(value: Column | str, condition: Column, window: WindowSpec) -> Column:
    """Cumulative mean over the rows that meet the condition."""
    column = F.col(value) if isinstance(value, str) else value
    return F.avg(F.when(condition, column)).over(window)


def blocked_running_sum(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    order: str,
    block: Column,
    out: str,
    span: Column | None = None,
) -> DataFrame:
    """:func:`running_sum` for groups of any size.

    Rows tied on the order column share a result, so they are summed first (map
    side), which leaves one row per key and order value. ``block`` must never
    decrease as the order column grows; no task holds more than one block of one
    group, or one group's block totals. For groups of very many blocks give ``span``,
    a coarser block made of whole blocks: totals are then carried within spans and
    across spans, and no task holds more than the blocks of one span.
    """
    keys = list(keys)
    spans = [] if span is None else ["__span"]
    peers = (
        df.groupBy(*keys, order)
        .agg(F.sum(value).alias("__peer_sum"))
        .withColumns({"__block": block} | ({} if span is None else {"__span": span}))
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    earlier = (Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys, *spans).orderBy("__block").rowsBetween(*earlier)
    sums = peers.groupBy(*keys, *spans, "__block").agg(F.sum("__peer_sum").alias("__block_sum"))
    carried = sums.withColumn("__carry", F.sum("__block_sum").over(before)).drop("__block_sum")
    if spans:
        across = Window.partitionBy(*keys).orderBy("__span").rowsBetween(*earlier)
        whole = sums.groupBy(*keys, "__span").agg(F.sum("__block_sum").alias("__span_sum"))
        whole = whole.withColumn("__base", F.sum("__span_sum").over(across)).drop("__span_sum")
        carry = F.when(F.col("__base").isNull(), F.col("__carry")).otherwise(
            F.col("__base") + F.coalesce("__carry", F.lit(0))
        )
        carried = _join_null_safe(carried, whole, [*keys, "__span"])
        carried = carried.withColumn("__carry", carry).drop("__span", "__base")
    partial = peers.withColumn("__partial", F.sum("__peer_sum").over(inside))
    totals = _join_null_safe(partial, carried, [*keys, "__block"]).select(
        *keys,
        order,
        F.when(F.col("__carry").isNull(), F.col("__partial"))
        .otherwise(F.col("__carry") + F.coalesce("__partial", F.lit(0)))
        .alias(out),
    )
    return _join_null_safe(df, totals, [*keys, order])


def blocked_delta(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    order: str,
    block: Column,
    out: str,
    span: Column | None = None,
) -> DataFrame:
    """:func:`delta` for groups of any size; the order column is unique per group.

    ``block`` and ``span`` as in :func:`blocked_running_sum`.
    """
    keys = list(keys)
    spans = [] if span is None else ["__span"]
    cut = df.withColumns({"__block": block} | ({} if span is None else {"__span": span}))
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    across = Window.partitionBy(*keys, *spans).orderBy("__block")
    lasts = cut.groupBy(*keys, *spans, "__block").agg(F.max_by(value, order).alias("__last"))
    carried = lasts.withColumn("__carry", F.lag("__last").over(across))
    if spans:
        ends = lasts.groupBy(*keys, "__span").agg(F.max_by("__last", "__block").alias("__end"))
        over_spans = Window.partitionBy(*keys).orderBy("__span")
        ends = ends.withColumn("__base", F.lag("__end").over(over_spans)).drop("__end")
        carried = carried.withColumn("__first", F.row_number().over(across) == 1)
        carried = _join_null_safe(carried, ends, [*keys, "__span"])
        carry = F.when(F.col("__first"), F.col("__base")).otherwise(F.col("__carry"))
        carried = carried.withColumn("__carry", carry).drop("__span", "__base", "__first")
        cut = cut.drop("__span")
    carried = carried.drop("__last")
    ranked = cut.withColumns(
        {"__position": F.row_number().over(inside), "__lag": F.lag(value).over(inside)}
    )
    previous = F.when(F.col("__position") == 1, F.col("__carry")).otherwise(F.col("__lag"))
    return (
        _join_null_safe(ranked, carried, [*keys, "__block"])
        .withColumn(out, F.col(value) - previous)
        .drop("__block", "__position", "__lag", "__carry")
    )


def latest_n(
    df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column], n: int, rank: str = "rn"
) -> DataFrame:
    """The ``n`` newest rows of each group with their rank.

    ``newest_first`` must order rows totally (end it with a unique column). The
    rank filter becomes a window group limit: every map task keeps ``n`` rows per
    group before the shuffle, so a hot group costs no more than a cold one.
    """
    window = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def spread_ranked(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], n: int, rank: str = "rn"
) -> DataFrame:
    """One row per group holding the ranked rows side by side (``value_1`` .. ``value_n``).

    The rank list is fixed, so no extra job looks for pivot values, and after
    :func:`latest_n` the grouping reuses the window's partitioning.
    """
    cells = [
        F.max(F.when(F.col(rank) == position, F.col(value))).alias(f"{value}_{position}")
        for position in range(1, n + 1)
        for value in values
    ]
    return df.groupBy(*keys).agg(*cells)


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on equal keys where NULL matches NULL, keeping the left key columns."""
    renamed = right.withColumnsRenamed({key: f"__r_{key}" for key in keys})
    condition = [F.col(key).eqNullSafe(F.col(f"__r_{key}")) for key in keys]
    return left.join(renamed, condition, "left").drop(*[f"__r_{key}" for key in keys])
