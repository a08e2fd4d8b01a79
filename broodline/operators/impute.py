"""Fill values computed from the data: exact median and mode as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(df: DataFrame, column: str) -> Column:
    """True where the column has a value: neither NULL nor, in a floating-point column, NaN."""
    found = F.col(column).isNotNull()
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        found = found & ~F.isnan(column)
    return found


def mode_value(df: DataFrame, column: str) -> Column:
    """Most frequent value, the smallest on ties, as a scalar subquery; NaN is no value."""
    return (
        df.where(present(df, column))
        .groupBy(F.col(column).alias("v"))
        .count()
        .orderBy(F.desc("count"), F.asc("v"))
        .limit(1)
        .select("v")
        .scalar()
    )


#: Groups that a round of the median counts values in, and the rows below which it counts single values.
SLOTS = 1 << 16


def exact_median(df: DataFrame, column: str, slots: int = SLOTS) -> Column:
    """Interpolated median as a scalar subquery, by radix selection.

    A round counts the values in slots that follow their order and keeps the one
    slot that holds the middle ranks. The first slots are sixteenths of an octave
    by sign and magnitude, the next cut the kept one evenly between its least and
    greatest value, the last are single values, of which there are few
    by then: after two even cuts no more than the ``slots`` doubles between two
    neighbours. Once a slot holds at most ``slots`` rows its values are counted
    singly at once, and the rounds behind it find nothing left to do. So there are two
    scans as a rule and four at most, each a map-side count of at most ``slots``
    groups (the first has about 67,000); no value is moved or ordered but as such a group.
    """
    value = F.col("v")
    values = df.select(F.col(column).cast("double").alias("v"))
    values = values.where(value.isNotNull() & ~F.isnan("v")).withColumn("octave", _octave(value))
    first = values.groupBy(F.col("octave").alias("slot"), "octave").agg(
        *_counts(), F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("n")
    )
    states = [_middle_slot(first)]
    for last in (False, False, True):
        open_ = F.broadcast(states[-1].where("not done"))  # one row at most
        inside = values.join(open_, "octave").where("v between least and greatest")
        even = F.floor((value - F.col("least")) / (F.col("greatest") - F.col("least")) * (slots - 1))
        single = F.lit(last) | (F.col("held") <= slots)
        folded = inside.groupBy(F.when(single, value).otherwise(even).alias("slot"), "octave", "before", "n").agg(*_counts())
        states.append(_middle_slot(folded))
    found = states[0].where("done").select("median")
    for state in states[1:]:
        found = found.unionAll(state.where("done").select("median"))
    return found.agg(F.max("median").alias("median")).scalar()


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("held"), F.min("v").alias("least"), F.max("v").alias("greatest")]


def _octave(value: Column) -> Column:
    """A whole number that grows with the value: its sign and sixteenths of the octave."""
    size = F.floor(F.log2(F.abs(value)) * 16) + 20_000  # from 2,816 to 36,384
    size = F.when(F.abs(value) == float("inf"), 40_000).otherwise(size)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(0).cast("int")


def _middle_slot(folded: DataFrame) -> DataFrame:
    """One row: the slot that holds the middle ranks, or the median if that is settled.

    ``folded`` has a row for each slot of one octave or of all, with the rows
    ``before`` them. The two middle ranks may lie in two neighbouring slots; they
    are then the greatest value of the one and the least of the other.
    """
    running = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = folded.withColumns(
        {
            "upto": F.col("before") + F.sum("held").over(running),
            "n": F.coalesce(F.col("n"), F.sum("held").over(everything)),
        }
    )
    middle = [F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1]
    holds = (F.col("upto") >= middle[0]) & (F.col("upto") - F.col("held") < middle[1])
    state = ranked.where(holds).agg(
        F.count(F.lit(1)).alias("parts"),
        F.min("octave").alias("octave"),
        F.max("n").alias("n"),
        F.min(F.col("upto") - F.col("held")).alias("before"),
        F.sum("held").alias("held"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        ((F.min_by("greatest", "slot") + F.max_by("least", "slot")) / 2).alias("between"),
    )
    single = F.col("parts") == 1
    median = F.when(single, F.col("least")).otherwise(F.col("between"))
    done = ~single | (F.col("least") == F.col("greatest"))
    return state.where("parts > 0").select(
        "octave", "n", "before", "held", "least", "greatest", done.alias("done"), median.alias("median")
    )


def fill_missing(column: str, value: Column, found: Column | None = None) -> Column:
    """The column, or ``value`` where it is NULL or not ``found`` (see :func:`present`)."""
    own = F.col(column) if found is None else F.when(found, F.col(column))
    return F.coalesce(own, value)
