"""Cycle tables derived from the TPC-H-like test tables.

``cycle_daily`` and its companions have the shape of the production tables the
plans expect, computed from ``events`` and the customer dimension. The raw events
are folded to one row per unit and day before any window or join, so however many
events one unit holds, it has at most one row per calendar day from there on.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broodline.operators.aggregate import row_sum
from broodline.sources.tables import read_table

MONEY = "decimal(18,2)"
FIRST_PERIOD = dt.date(2024, 1, 1)


# Columns of the test tables, so that no job has to infer them.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name, columns=COLUMNS[name])


def cycle_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (unit, cycle start, age) with cumulative counters."""
    events = table(spark, sf_dir, "events")
    day = F.col("ts").cast("date")
    daily = events.groupBy(
        F.col("user_id").alias("unit"),
        F.trunc(day, "WEEK").alias("cycle_start"),
        day.alias("obs_date"),
    ).agg(
        F.count_if(F.col("event_type") == "error").alias("depletion"),
        F.count_if(F.col("event_type") == "purchase").alias("harvest"),
        F.sum(F.col("value").cast(MONEY)).alias("feed"),
    )
    window = Window.partitionBy("unit", "cycle_start").orderBy("age")
    return (
        daily.withColumn("age", F.date_diff("obs_date", "cycle_start") + 1)
        .withColumns(
            {
                "initial_pop": 1000 + F.col("unit") % 50,
                "bw": (40 + 55 * F.col("age") + F.col("unit") % 7).cast("double"),
                "cum_depletion": F.sum("depletion").over(window),
                "cum_harvest": F.sum("harvest").over(window),
                "cum_feed": F.sum("feed").over(window).cast("double"),
            }
        )
        .select(
            "unit",
            "cycle_start",
            "obs_date",
            "age",
            "initial_pop",
            (F.col("initial_pop") - F.col("cum_depletion") - F.col("cum_harvest")).alias("pop_end"),
            "cum_depletion",
            "cum_harvest",
            "cum_feed",
            "bw",
            (F.col("cum_feed") / (F.col("bw") * F.col("initial_pop") / 1000)).alias("fcr"),
            (F.col("cum_depletion") * 100.0 / F.col("initial_pop")).alias("total_depletion"),
        )
    )


def unit_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per unit: officer, manager, area and partnership."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("unit"),
            F.col("c_mktsegment").alias("officer"),
            F.col("n_name").alias("manager"),
            F.col("r_name").alias("area"),
            F.when(F.col("c_acctbal") < 3000, "partner").otherwise("own").alias("partnership"),
        )
    )


def monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle days on which the unit was looked at, with the period number."""
    day = F.col("ts").cast("date")
    start = F.trunc(day, "WEEK")
    looks = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    days = looks.select(
        F.col("user_id").alias("unit_name"),
        start.alias("start_date"),
        (F.date_diff(day, start) + 1).alias("day_age"),
    ).distinct()
    weeks = F.floor(F.date_diff("start_date", F.lit(FIRST_PERIOD)) / 7)
    return days.withColumn("period", (weeks + 1).cast("int"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sale."""
    kg = F.col("value").cast(MONEY)
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").alias("unit"),
            F.col("ts").cast("date").alias("sale_date"),
            kg.alias("kg"),
            (1 + F.col("event_id") % 3).alias("birds"),
            (kg * 20).cast(MONEY).alias("amount"),
            (800 + F.col("event_id") % 1500).alias("weight"),
        )
    )


def standard(spark: SparkSession) -> DataFrame:
    """Standard curve for days 1 to 6; day 7 is missing, so it stays unmatched."""
    age = F.col("age")
    return spark.range(1, 7).select(
        F.col("id").cast("int").alias("age"),
    ).select(
        "age",
        ((40 + 55 * age) / 1000).alias("bw_std"),
        F.lit(0.055).alias("adg_std"),
        (1 + age / 10).alias("fcr_std"),
        (age / 500).alias("mortality_std"),
    )


def cycle_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cycle with its (partly misspelt) brand labels and first-week weights."""
    day = F.col("ts").cast("date")
    unit = F.col("unit")
    cycles = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("unit"), F.trunc(day, "WEEK").alias("cycle_start"))
        .agg(
            F.count_if(F.col("event_type") == "error").alias("errors"),
            (F.date_diff(F.max(day), F.first(F.trunc(day, "WEEK"))) + 1).alias("last_age"),
        )
    )
    brand = F.concat(F.lit("D"), (unit % 5).cast("string"))
    return cycles.join(unit_dim(spark, sf_dir), "unit").select(
        "unit",
        "cycle_start",
        F.when(unit % 13 == 0, "D?").when(unit % 11 == 0, F.lower(brand)).otherwise(brand).alias("doc"),
        F.when(unit % 17 == 0, F.lower("area")).otherwise(F.col("area")).alias("hatchery"),
        F.when(unit % 19 == 0, "-").otherwise(F.col("officer")).alias("feed"),
        F.when(unit % 37 == 0, "n/a")
        .when(unit % 29 == 0, "0")
        .otherwise((40 + unit % 7).cast("string"))
        .alias("bw_0"),
        (40 + 55 * F.col("last_age")).cast("string").alias("bw_8"),
        (F.col("errors") / 8.0).alias("mortality_8"),
    )


# Fixed names of the wide feed table's columns in the test binding.
FEED_BRANDS = ["click", "view", "error", "signup", "purchase"]
FEED_PHASES = ["p1", "p2", "p3"]
FEED_DAYS = range(1, 8)


def wide_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cycle with ``{brand}_{day}`` and ``{phase}_{brand}_{day}`` counts."""
    day = F.col("ts").cast("date")
    hour = F.hour("ts")
    phase = F.when(hour < 8, "p1").when(hour < 16, "p2").otherwise("p3")
    brand_day = F.concat("event_type", F.lit("_"), F.weekday(day) + 1)
    cents = (F.col("value").cast(MONEY) * 100).cast("long")

    def entry(name, amount):
        return F.struct(name.alias("name"), amount.alias("amount"))

    one = F.lit(1).cast("long")
    entries = F.array(
        entry(brand_day, one),
        entry(F.concat(phase, F.lit("_"), brand_day), one),
        entry(F.lit("cents"), cents),
    )
    names = [f"{b}_{d}" for b in FEED_BRANDS for d in FEED_DAYS]
    names += [f"{p}_{name}" for p in FEED_PHASES for name in names]
    wide = (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("unit"),
            F.trunc(day, "WEEK").alias("cycle_start"),
            F.inline(entries),
        )
        .groupBy("unit", "cycle_start")
        .pivot("name", [*names, "cents"])
        .agg(F.sum("amount"))
    )
    per_brand = [
        F.struct(row_sum([f"{b}_{d}" for d in FEED_DAYS]), F.lit(b).alias("brand"))
        for b in FEED_BRANDS
    ]
    return wide.withColumns(
        {"outcome": F.col("cents") / 100, "top_feed": F.array_max(F.array(*per_brand))["brand"]}
    ).drop("cents")


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their part's brand, type and (sometimes missing) price."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        "p_brand",
        "p_type",
        F.when(F.col("p_partkey") % 10 != 0, (F.col("p_retailprice") - 900) * 120 + 1000).alias(
            "price"
        ),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.col("l_shipdate").cast("date").alias("cycle_start"), "l_extendedprice"
    )
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "cycle_start", "p_brand", "p_type", "price", "l_extendedprice"
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; most have none, so both label columns hold NULLs."""
    return table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
