"""Daily performance index of production cycles against a standard curve.

Stages: cycle metrics (ordered windows per cycle) -> dimension and monitoring
joins -> daily sales -> index -> report. Every window partitions by the same two
keys, so Spark sorts a cycle once per join boundary.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broodline.functions.numeric import or_zero, zero_guarded_ratio
from broodline.operators.aggregate import ratio_of_sums
from broodline.operators.filters import one_of, within_range
from broodline.operators.joins import join_renamed
from broodline.operators.windows import by_age, delta, running_mean_where, running_sum

CYCLE = ["unit", "cycle_start"]
CYCLE_DAY = [*CYCLE, "age"]

REPORT = [
    "unit",
    "cycle_start",
    "period",
    "obs_date",
    "age",
    "bw_actual",
    "bw_standard",
    "adg_actual",
    "adg_standard",
    "fcr_actual",
    "fcr_standard",
    "depletion_actual",
    "mortality_standard",
    "officer",
    "manager",
    "area",
    "ip",
]


def cycle_metrics(cycles: DataFrame) -> DataFrame:
    """Per-day metrics of each cycle: weight, harvest, feed conversion, quick index."""
    window = by_age(CYCLE, "age")
    harvest = F.col("harvest_daily")
    quick = (100 - F.col("total_depletion")) * F.col("bw") * 0.1
    return (
        cycles.withColumns(
            {
                "total_bw": F.col("bw") * (F.col("pop_end") + F.col("cum_harvest")) / 1000,
                "harvest_daily": delta("cum_harvest", window),
                "adg": delta("bw", window),
                "age_alive": F.col("pop_end") * F.col("age"),
            }
        )
        .withColumns(
            {
                "fcr_calc": zero_guarded_ratio(F.col("cum_feed"), F.col("total_bw")),
                "catch_age_daily": F.when(harvest == 0, 0).otherwise(F.col("age") * harvest),
            }
        )
        .withColumns(
            {
                "catch_age_cum": running_sum("catch_age_daily", window),
                "harvest_age": F.when(
                    harvest > 0, running_mean_where("age", harvest > 0, window)
                ).otherwise(F.col("age")),
            }
        )
        .withColumn(
            "ip_quick",
            F.when(F.col("fcr_calc") == 0, 0.0).otherwise(
                F.try_divide(quick, F.col("fcr_calc") * F.col("harvest_age"))
            ),
        )
    )


def daily_sales(sales: DataFrame) -> DataFrame:
    """Sales per unit and day with the weighted price per kilogram.

    Actual weights are summed where the table has them (column ``weight``).
    """
    weights = [F.sum("weight").alias("weight")] if "weight" in sales.columns else []
    return (
        sales.where((F.col("amount") > 0) | (F.col("kg") > 0))
        .groupBy("unit", "sale_date")
        .agg(
            F.sum("kg").alias("kg"),
            F.sum("birds").alias("birds"),
            F.sum("amount").alias("amount"),
            *weights,
            ratio_of_sums(F.col("amount").cast("double"), F.col("kg").cast("double")).alias(
                "price_per_kg"
            ),
        )
    )


def with_standard(days: DataFrame, standard: DataFrame) -> DataFrame:
    """Actual values beside the standard of the same age; ages without one are kept."""
    return join_renamed(days, standard, {"age": "age"}, "left").withColumns(
        {
            "bw_standard": F.col("bw_std") * 1000,
            "adg_standard": F.col("adg_std") * 1000,
            "fcr_standard": F.col("fcr_std"),
            "mortality_standard": F.col("mortality_std") * 100,
        }
    )


def with_index(days: DataFrame, sales_by_day: DataFrame) -> DataFrame:
    """Add ``valid`` and ``ip``: the index of each day, NULL on days without one.

    Where sales have weights, ``weight_sold`` is their sum of the day, 0 without sales.
    """
    weights = ["weight"] if "weight" in sales_by_day.columns else []
    window = by_age(CYCLE, "age")
    sold = sales_by_day.select(
        F.col("unit").alias("sale_unit"),
        "sale_date",
        F.col("kg").alias("sold_kg"),
        F.col("birds").alias("sold_birds"),
        *[F.col(name).alias("weight_sold") for name in weights],
    )
    merged = join_renamed(days, sold, {"unit": "sale_unit", "obs_date": "sale_date"}, "left")
    age, living = F.col("age"), F.col("living")
    index = zero_guarded_index(
        survival=F.try_divide(F.col("initial_pop") - F.col("cum_depletion"), F.col("initial_pop")),
        mean_weight=F.try_divide(F.col("total_kg"), living) * 1000,
        feed_conversion=F.try_divide(F.col("cum_feed"), F.col("total_kg")),
        mean_age=F.try_divide(F.col("age_sold_cum") + age * F.col("pop_end"), living),
    )
    if weights:
        merged = merged.withColumn("weight_sold", or_zero("weight_sold"))
    valid = (F.col("bw") > 0) & (F.col("initial_pop") > 0) & (F.col("total_kg") > 0)
    return (
        merged.withColumns(
            {
                "depletion_daily": delta("cum_depletion", window),
                "live_kg": F.col("pop_end") * F.col("bw") / 1000,
                "living": F.col("initial_pop") - F.col("cum_depletion"),
                "sold_kg_cum": running_sum(or_zero("sold_kg"), window).cast("double"),
                "age_sold_cum": running_sum(age * or_zero("sold_birds"), window),
            }
        )
        .withColumn("total_kg", F.col("sold_kg_cum") + F.col("live_kg"))
        .withColumn("valid", F.coalesce(valid, F.lit(False)))
        .withColumn("ip", F.when(F.col("valid"), index))
    )


def index_by_key(days: DataFrame) -> DataFrame:
    """Every day once per valid index of its key, with that index; once without any.

    What a left join of the days with the valid ones on the key gives, in one pass:
    the window follows the partitioning and order of the cycle windows.
    """
    same_key = Window.partitionBy(*CYCLE_DAY)
    valid = F.collect_list(F.when(F.col("valid"), F.struct("ip"))).over(same_key)
    each = days.withColumn("__valid", valid).drop("ip")
    each = each.withColumn("__index", F.explode_outer("__valid"))
    return each.withColumn("ip", F.col("__index")["ip"]).drop("__valid", "__index")


def zero_guarded_index(
    survival: Column, mean_weight: Column, feed_conversion: Column, mean_age: Column
) -> Column:
    return F.when(feed_conversion == 0, 0.0).otherwise(
        F.try_divide(survival * mean_weight, feed_conversion * mean_age) * 10
    )


def monitored_days(
    cycles: DataFrame,
    units: DataFrame,
    monitored: DataFrame,
    start_from: dt.date | None = None,
    start_to: dt.date | None = None,
    officers: Sequence[str] | None = None,
    managers: Sequence[str] | None = None,
    areas: Sequence[str] | None = None,
    partnerships: Sequence[str] | None = None,
    unit_names: Sequence[int] | None = None,
    periods: Sequence[int] | None = None,
) -> DataFrame:
    """Cycle metrics of the monitored days with officer, manager, area and period.

    The date range filters a partition key of the windows, so it reaches the scan.
    """
    wanted = within_range(cycles, "cycle_start", start_from, start_to)
    chosen = {"officer": officers, "manager": managers, "area": areas, "partnership": partnerships}
    dimension = one_of(units, chosen)
    watched = one_of(monitored, {"unit_name": unit_names, "period": periods})
    metrics = join_renamed(cycle_metrics(wanted), dimension, {"unit": "unit"})
    return join_renamed(
        metrics, watched, {"unit": "unit_name", "cycle_start": "start_date", "age": "day_age"}
    )


def performance_index(
    cycles: DataFrame,
    units: DataFrame,
    monitored: DataFrame,
    sales: DataFrame,
    standard: DataFrame,
    keys_unique: bool = False,
    **filters,
) -> DataFrame:
    """The report: actual and standard values of every monitored day with its index.

    The report rows and the index rows are two views of the same joined days,
    matched by (unit, cycle start, age), which repeats rows of repeated keys. With
    ``keys_unique`` the caller states that the key occurs once, and the index is
    simply a column.
    """
    days = monitored_days(cycles, units, monitored, **filters)
    indexed = with_index(days, daily_sales(sales))
    report = indexed if keys_unique else index_by_key(indexed)
    return (
        with_standard(report, standard)
        .withColumnsRenamed(
            {
                "bw": "bw_actual",
                "adg": "adg_actual",
                "fcr": "fcr_actual",
                "total_depletion": "depletion_actual",
            }
        )
        .select(*REPORT)
    )
