"""Correlations from sums that can be stored and added to.

A state has one row for each group: the number of rows, means, squared deviations
and joint deviations. Two states of one group merge to the state of all their rows
(Chan, Golub and LeVeque 1983), so a report over new days folds these days alone
and adds them to what is there. Deviations are always taken from a mean, never as a
difference of large sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broodline.functions.numeric import nan_as_null
from broodline.operators.association import BUCKET


def pair_moments(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """``by.., n, mean_x, mean_y, dev_x, dev_y, dev_xy`` of the rows that have both values."""
    values = rows.select(*by, *[nan_as_null(F.col(c).cast("double")).alias(name) for c, name in ((x, "x"), (y, "y"))])
    known = values.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    n = F.count(F.lit(1))
    return known.groupBy(*by).agg(
        n.alias("n"),
        F.avg("x").alias("mean_x"),
        F.avg("y").alias("mean_y"),
        (F.var_pop("x") * n).alias("dev_x"),
        (F.var_pop("y") * n).alias("dev_y"),
        (F.covar_pop("x", "y") * n).alias("dev_xy"),
    )


def merge_pairs(state: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row for each group, of all its states together."""
    apart_x, apart_y = (F.col(f"mean_{v}") - F.col(f"__{v}") for v in "xy")
    whole = _with_means(state, by, ["x", "y"])
    return whole.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.max("__x").alias("mean_x"),
        F.max("__y").alias("mean_y"),
        F.sum(F.col("dev_x") + F.col("n") * apart_x * apart_x).alias("dev_x"),
        F.sum(F.col("dev_y") + F.col("n") * apart_y * apart_y).alias("dev_y"),
        F.sum(F.col("dev_xy") + F.col("n") * apart_x * apart_y).alias("dev_xy"),
    )


def pair_correlation(state: DataFrame, digits: int = 3) -> DataFrame:
    """The state with Pearson's ``r``; NULL where a column is constant."""
    spread = F.sqrt(F.col("dev_x")) * F.sqrt(F.col("dev_y"))
    # Adding 0.0 turns a rounded -0.0 into 0.0.
    return state.withColumn("r", F.when(spread > 0, F.round(F.col("dev_xy") / spread, digits) + 0.0))


def indicator_cells(rows: DataFrame, cell: Sequence[str], outcome: str, by: Sequence[str] = BUCKET) -> DataFrame:
    """``by.., cell.., n, mean_y, dev_y``: the state for correlations of categories with an outcome."""
    y = nan_as_null(F.col(outcome).cast("double"))
    known = rows.select(*by, *cell, y.alias("y")).where(F.col("y").isNotNull())
    n = F.count(F.lit(1))
    return known.groupBy(*by, *cell).agg(n.alias("n"), F.avg("y").alias("mean_y"), (F.var_pop("y") * n).alias("dev_y"))


def merge_cells(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each combination of ``keys``, of all its cells together."""
    apart = F.col("mean_y") - F.col("__y")
    return _with_means(state, keys, ["y"]).groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.max("__y").alias("mean_y"),
        F.sum(F.col("dev_y") + F.col("n") * apart * apart).alias("dev_y"),
    )


def cells_correlation(
    state: DataFrame, features: Column, bucket: Sequence[str] = BUCKET, digits: int = 3
) -> DataFrame:
    """``(bucket.., feature, n, n_feature, r)`` as ``indicator_correlation`` gives it, from stored cells.

    ``features`` is an array naming the indicators that are 1, computed from the cell
    columns; cells of one day, week or delivery each may be given together.
    """
    keys = list(bucket)
    whole = merge_cells(state, keys).select(*keys, "n", F.col("mean_y").alias("mean_all"), "dev_y")
    named = state.withColumn("feature", F.explode(F.array_compact(features)))
    weighted = F.sum(F.col("n") * F.col("mean_y"))
    per_feature = named.groupBy(*keys, "feature").agg(
        F.sum("n").alias("n_feature"), (weighted / F.sum("n")).alias("mean_feature")
    )
    marked = whole.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = per_feature.join(marked, same)
    share = F.col("n_feature") / F.col("n")
    defined = (F.col("n") > F.col("n_feature")) & (F.col("dev_y") > 0)
    variance = F.col("dev_y") / F.col("n")
    r = (F.col("mean_feature") - F.col("mean_all")) * F.sqrt(F.try_divide(share, (1 - share) * variance))
    return joined.select(*keys, "feature", "n", "n_feature", F.when(defined, F.round(r, digits) + 0.0).alias("r"))


def _with_means(state: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    group = Window.partitionBy(*by)
    total = F.sum("n").over(group)
    return state.withColumns({f"__{v}": F.sum(F.col("n") * F.col(f"mean_{v}")).over(group) / total for v in values})
