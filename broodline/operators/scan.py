"""Running values over groups of any size, for any state that can be put together from parts.

Rows are dealt by ranges of (group, order), whatever the sizes of the groups, and
the ranges are written once, so that every later step sees the same ones. Within a
range a window runs as usual. A group that goes on over several ranges takes over
the state at the end of the ranges before; every boundary parts at most one group, so
there are no more such states than ranges. No task holds more than a range, and the
caller names no blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broodline.operators.windows import _join_null_safe
from broodline.sources.scratch import written


@dataclass(frozen=True)
class State:
    """A running value: what each row adds, how two parts join (``sum``, ``min``, ``max``, ``last``), and the result."""

    adds: tuple[Column, ...]
    joins: tuple[str, ...]
    result: Callable[..., Column] = lambda only: only


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def total(value: Column | str) -> State:
    """Sum of the values so far; NULL before the first one."""
    return State((_column(value),), ("sum",))


def mean_where(value: Column | str, condition: Column) -> State:
    """Mean of the values so far in rows that meet the condition."""
    counted = F.when(condition, _column(value))
    number = F.when(counted.isNotNull(), 1).otherwise(0)
    return State((counted, number), ("sum", "sum"), lambda s, n: F.when(n > 0, s.cast("double") / n))


def least(value: Column | str) -> State:
    return State((_column(value),), ("min",))


def greatest(value: Column | str) -> State:
    return State((_column(value),), ("max",))


def last(value: Column | str) -> State:
    """The value of the newest row, also if that is NULL; the order column must be unique in a group."""
    return State((_column(value),), ("last",))


_WITHIN = {"sum": F.sum, "min": F.min, "max": F.max, "last": F.last}


def _joined(how: str, earlier: Column, here: Column, has_here: Column) -> Column:
    if how == "last":
        return F.when(has_here, here).otherwise(earlier)
    both = {"sum": earlier + here, "min": F.least(earlier, here), "max": F.greatest(earlier, here)}[how]
    return F.coalesce(both, earlier, here)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    states: Mapping[str, State],
    before: bool = False,
    unique: bool = False,
) -> DataFrame:
    """All rows and columns with a running value for each of ``states``.

    A value covers the rows of the group up to the row's place in ascending order,
    tied rows included, or with ``before`` only the rows of lesser order. NULL
    groups are a group, NULL orders come first. Tied rows are folded on the map
    side and share a result; ``unique`` says that there are none, which spares
    the fold and the join back.
    """
    if unknown := {how for s in states.values() for how in s.joins} - set(_WITHIN):
        raise ValueError(f"no way to join {sorted(unknown)}")
    keys = list(keys)
    parts = [(name, k, add, how) for name, s in states.items() for k, (add, how) in enumerate(zip(s.adds, s.joins, strict=True))]
    cells = {f"__{name}_{k}": add for name, k, add, _ in parts}
    hows = {f"__{name}_{k}": how for name, k, _, how in parts}
    rows = df.withColumns(cells)
    if not unique:
        fold = {"sum": F.sum, "min": F.min, "max": F.max, "last": F.any_value}
        rows = rows.groupBy(*keys, order).agg(*[fold[hows[c]](c).alias(c) for c in cells])
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(number, *keys, order).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "ranges")

    place = F.struct(F.col(order))  # a NULL order is the least, not missing
    ends = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.max_by(c, place)}
    ended = dealt.groupBy(*keys, "__part").agg(*[ends[hows[c]](c).alias(c) for c in cells])
    over = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carries = {f"{c}_carry": _WITHIN[hows[c]](c).over(over) for c in cells}
    first = Window.partitionBy(*keys).orderBy("__part")
    carried = ended.withColumns(carries | {"__nth": F.row_number().over(first)}).where("__nth > 1")
    carried = F.broadcast(carried.select(*keys, "__part", *carries))  # a row for each range at most

    here = Window.partitionBy(*keys, "__part").orderBy(order)
    frame = here.rowsBetween(Window.unboundedPreceding, -1) if before else here.rowsBetween(Window.unboundedPreceding, 0)
    local = {f"{c}_here": _WITHIN[hows[c]](c).over(frame) for c in cells}
    # Rows of a range lie together already, so the window needs no further exchange.
    ranged = dealt.repartitionById(number, F.col("__part"))
    ranged = ranged.withColumns(local | {"__has": (F.row_number().over(here) > 1) | F.lit(not before)})
    scanned = _join_null_safe(ranged, carried, [*keys, "__part"])
    values = {
        name: s.result(
            *[
                _joined(how, F.col(f"__{name}_{k}_carry"), F.col(f"__{name}_{k}_here"), F.col("__has"))
                for k, how in enumerate(s.joins)
            ]
        )
        for name, s in states.items()
    }
    scanned = scanned.withColumns(values)
    if unique:
        return scanned.select(*df.columns, *states)
    return _join_null_safe(df, scanned.select(*keys, order, *states), [*keys, order])

