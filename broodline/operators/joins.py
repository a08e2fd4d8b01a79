"""Equi-joins between tables that name or spell their keys differently.

No join here carries a broadcast hint. Spark broadcasts a side only when its
size is known to be under ``spark.sql.autoBroadcastJoinThreshold`` (at planning,
or from shuffle statistics at run time) and otherwise sort-merges, with adaptive
skew splitting for hot keys, so the same code serves a 25-row lookup and a
billion-row dimension.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodline.functions.text import normalized_key


def join_renamed(
    left: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "inner"
) -> DataFrame:
    """Join on ``{left name: right name}`` and keep only the left spelling of the keys."""
    marked = {name: f"__r_{name}" for name in keys.values()}
    clash = (set(left.columns) & set(right.columns)) - set(keys.values())
    if clash:
        raise ValueError(f"both sides have columns named {sorted(clash)}; rename one side")
    condition = [F.col(a) == F.col(marked[b]) for a, b in keys.items()]
    return left.join(right.withColumnsRenamed(marked), condition, how).drop(*marked.values())


def join_normalized(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left"
) -> DataFrame:
    """Join on trimmed, upper-cased names; a NULL name matches nothing.

    Both key forms are computed once per row before the join, so it stays an
    ordinary equi-join.
    """
    a = left.withColumn("__left_key", normalized_key(left_key))
    b = right.withColumn("__right_key", normalized_key(right_key))
    joined = a.join(b, F.col("__left_key") == F.col("__right_key"), how)
    return joined.drop("__left_key", "__right_key")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, failing the query if a key occurs twice.

    Meant for a dimension about to be joined: duplicates there multiply facts.
    The grouping partitions by the join keys, so a join on them needs no further
    exchange of this side.
    """
    others = [name for name in df.columns if name not in keys]
    message = F.lit(f"duplicate key in columns {list(keys)}")
    counted = df.groupBy(*keys).agg(
        F.any_value(F.struct(*others)).alias("__row"), F.count(F.lit(1)).alias("__n")
    )
    # A filter, since a column that nothing reads would be pruned together with the check.
    checked = counted.where(
        F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    )
    return checked.select(
        *keys, *[F.col("__row")[name].alias(name) for name in others]
    )


def skew_joined(
    left: DataFrame, right: DataFrame, keys: Sequence[str], block: int = 2000
) -> DataFrame:
    """Inner equi-join whose work per task is bounded by a ``block`` x ``block`` tile.

    A key with many rows on **both** sides costs rows(left) x rows(right)
    comparisons, which byte-based skew handling does not see. Such keys are cut
    into tiles: each side is split into slices of about ``block`` rows and meets
    every slice of the other side once. Keys below ``block`` on both sides get
    one tile. Meant for joins whose caller filters the pairs in the same stage.
    A slice follows from the whole row, so a retried task repeats it; equal rows
    share a slice, and callers with many of them fold them to counts first.
    """
    keys = list(keys)
    one, none = F.lit(1).alias("n_l"), F.lit(0).alias("n_r")
    sizes = left.select(*keys, one, none).unionByName(
        right.select(*keys, none.alias("n_l"), one.alias("n_r"))
    )
    sizes = sizes.groupBy(*keys).agg(F.sum("n_l").alias("n_l"), F.sum("n_r").alias("n_r"))
    hot = sizes.where(
        ((F.col("n_l") > block) | (F.col("n_r") > block)) & (F.col("n_l") > 0) & (F.col("n_r") > 0)
    ).select(
        *keys,
        F.ceil(F.col("n_l") / block).cast("int").alias("__cut_l"),
        F.ceil(F.col("n_r") / block).cast("int").alias("__cut_r"),
    )

    def tiled(side: DataFrame, mine: str, theirs: str, own: str, other: str) -> DataFrame:
        slice_of = F.pmod(F.xxhash64(*side.columns), F.coalesce(F.col(mine), F.lit(1)))
        copies = F.sequence(F.lit(0), F.coalesce(F.col(theirs), F.lit(1)) - 1)
        return (
            side.join(hot, keys, "left")
            .withColumns({own: slice_of.cast("int"), other: F.explode(copies)})
            .drop("__cut_l", "__cut_r")
        )

    tiles = [*keys, "__tile_l", "__tile_r"]
    a = spread(tiled(left, "__cut_l", "__cut_r", "__tile_l", "__tile_r"), *tiles)
    b = spread(tiled(right, "__cut_r", "__cut_l", "__tile_r", "__tile_l"), *tiles)
    return a.join(b, tiles).drop("__tile_l", "__tile_r")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Partition by the columns, or evenly, into the session's number of shuffle partitions.

    For inputs that are small in bytes but costly per row: a stated number keeps
    adaptive execution from merging the partitions by their size.
    """
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(number, *columns)
