"""Living population per age band, by province, branch and manager."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broodline.functions.numeric import age_band
from broodline.functions.text import ReplaceRules, canonicalize, normalized_key
from broodline.operators.aggregate import conditional_sums
from broodline.operators.filters import last_n_days

# Band labels and their report columns. Older bands are not reported.
BAND_COLUMNS = {
    "w1": "W1 (0-7)",
    "w2": "W2 (7-14)",
    "w3": "W3 (14-21)",
    "w4": "W4 (21-28)",
}


def latest_living(
    cycles: DataFrame, last_days: int | None = None, as_of: dt.date | None = None
) -> DataFrame:
    """The last day of each cycle, if anything is alive on it.

    The population test comes after ranking: a cycle that ended with nothing
    alive is left out rather than represented by an earlier day. Cycles are told
    apart by the unit name as recorded.
    """
    window = Window.partitionBy("unit_name", "cycle_start").orderBy(F.col("age").desc())
    latest = cycles.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= 1)
    return last_n_days(latest.where(F.col("pop_end") > 0), "obs_date", last_days, as_of).drop("rn")


def population_by_age_band(
    cycles: DataFrame,
    units: DataFrame,
    officers: DataFrame,
    unit_rules: ReplaceRules = (),
    officer_rules: ReplaceRules = (),
    manager_rules: ReplaceRules = (),
    last_days: int | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Band totals per province, branch and manager, NULL groups last.

    Populations are summed per unit name before the name joins. Sums distribute
    over a join on that name, so the result is the same and the joins see one row
    per unit. Units or officers without a match stay, under NULL.
    """
    unit_key = normalized_key(canonicalize("unit_name", unit_rules))
    bands = conditional_sums("pop_end", age_band("age"), BAND_COLUMNS)
    per_unit = (
        latest_living(cycles, last_days, as_of).groupBy(unit_key.alias("unit_key")).agg(*bands)
    )
    masters = units.select(
        normalized_key("unit_name").alias("master_key"),
        normalized_key(canonicalize("officer", officer_rules)).alias("officer_key"),
        canonicalize("manager", manager_rules, strip="").alias("manager"),
    )
    branches = (
        officers.select("officer", "branch", "province")
        .distinct()
        .select(
            normalized_key(canonicalize("officer", officer_rules)).alias("branch_key"),
            "branch",
            "province",
        )
    )
    return (
        per_unit.join(masters, F.col("unit_key") == F.col("master_key"), "left")
        .join(branches, F.col("officer_key") == F.col("branch_key"), "left")
        .groupBy("province", "branch", "manager")
        .agg(*[F.sum(name).alias(name) for name in BAND_COLUMNS.values()])
        .withColumn("Grand Total", sum_columns(list(BAND_COLUMNS.values())))
        .orderBy(*[F.col(c).asc_nulls_last() for c in ("province", "branch", "manager")])
        .withColumnsRenamed(
            {"province": "Province", "branch": "Unit", "manager": "Mitra Manager"}
        )
    )


def sum_columns(names: list[str]):
    total = F.col(f"`{names[0]}`")
    for name in names[1:]:
        total = total + F.col(f"`{name}`")
    return total
