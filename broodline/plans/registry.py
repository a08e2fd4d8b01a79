"""Named queries over the test tables, one or more per operator."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.functions.calendar import bucket_label, calendar_parts, week_of_month
from broodline.functions.numeric import age_band, growth_rate, or_zero, percent, price_band
from broodline.functions.text import (
    DAY_FORMATS,
    canonicalize,
    capitalize,
    compound,
    recode,
    to_day,
    to_number,
)
from broodline.operators import profile as facts
from broodline.operators import profile_state as states
from broodline.operators import moments, scan
from broodline.operators.aggregate import family_columns, one_hot, one_hot_found, row_sums, used_families
from broodline.operators.association import BUCKET, correlation_report
from broodline.operators.cleanse import CleanseRules, cleanse
from broodline.operators.filters import last_n_days, one_of, within_range
from broodline.operators.fuzzy import WORD_PART, WORD_SET, fuzzy_topk_join, sorted_words
from broodline.operators.impute import exact_median, fill_missing, mode_value, present
from broodline.operators.joins import join_normalized, join_renamed, require_unique
from broodline.operators.scan import prefix_scan
from broodline.operators.windows import (
    blocked_delta,
    blocked_running_sum,
    by_age,
    latest_n,
    running_mean_where,
    spread_ranked,
)
from broodline.plans import bindings as b
from broodline.plans import performance_index as pi
from broodline.plans.age_bands import latest_living, population_by_age_band
from broodline.plans.brand_reports import (
    PLACE_CELL,
    brand_and_place,
    brand_and_price,
    feed_brands,
    place_features,
    place_rows,
)
from broodline.plans.intake import intake
from broodline.plans.scorecards import recent_scorecard
from broodline.sources.bucketed import write_bucketed
from broodline.sources.scratch import scratch_path
from broodline.sources.sinks import (
    upsert_partitions,
    upsert_version,
    write_append,
    write_overwrite,
    write_sheet,
    write_upsert,
)
from broodline.sources.tables import read_sheets, read_table, register_views, union_tagged
from broodline.sources.versions import APPEND, REPLACE_ALL, read_version, write_version

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(key: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[key] = build
        return build

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results compare by value across engines."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({name: F.round(F.col(f"`{name}`"), digits) for name in doubles})


# --- sources and projections -------------------------------------------------


@query("scan_table")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "customer")


@query("search_path_scan")
def search_path_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found along the search path: ``nation`` in both folders, ``region`` in the second."""
    root = scratch_path(spark, "schemas")
    nation = b.table(spark, sf_dir, "nation")
    write_overwrite(nation, f"{root}/dbo/nation")
    write_overwrite(nation.where("n_nationkey < 0"), f"{root}/ops/nation.parquet")
    write_overwrite(b.table(spark, sf_dir, "region"), f"{root}/ops/region.parquet")
    found, region = [read_table(spark, root, name, "ops") for name in ("nation", "region")]
    return join_renamed(found, region, {"n_regionkey": "r_regionkey"})


@query("catalog_views")
def catalog_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers per region in SQL over views of the tables."""
    names = ["supplier", "nation", "region"]
    register_views(spark, sf_dir, names)
    return spark.sql("""
        SELECT r_name, count(*) AS suppliers, max(s_acctbal) AS most
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")


def _customer_rules() -> CleanseRules:
    return CleanseRules(
        drop_duplicates=True,
        fill={"c_acctbal": 0.0},
        fill_with_mode=["c_nationkey"],
        drop=["c_name"],
        recode={"c_mktsegment": {"BUILDING": "Building", "MACHINERY": None}},
        keep=F.col("c_acctbal") > 0,
    )


@query("intake_profile")
def intake_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First contact with a table: its profile."""
    return intake(spark, sf_dir, "customer", rules=_customer_rules()).facts


@query("intake_cleansed")
def intake_cleansed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First contact with a table: its cleansed form."""
    return intake(spark, sf_dir, "customer", rules=_customer_rules()).cleansed


@query("read_many_union")
def read_many_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("party"), F.col("c_acctbal").alias("balance"), "c_mktsegment"
    )
    suppliers = b.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("party"), F.col("s_acctbal").alias("balance")
    )
    return union_tagged({"customer": customers, "supplier": suppliers})


@query("project_rename")
def project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.cycle_daily(spark, sf_dir).select(
        F.col("unit").alias("house"),
        F.col("cycle_start").alias("placed_on"),
        F.col("obs_date").alias("cut_off"),
        F.col("age").alias("day"),
        F.col("pop_end").alias("birds"),
    )


@query("computed_metrics")
def computed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        b.cycle_daily(spark, sf_dir).select(
            "unit",
            "cycle_start",
            "age",
            (F.col("bw") * (F.col("pop_end") + F.col("cum_harvest")) / 1000).alias("total_bw"),
            (F.col("pop_end") * F.col("bw") / 1000).alias("live_kg"),
            (F.col("pop_end") * F.col("age")).alias("age_alive"),
            (F.col("initial_pop") - F.col("cum_depletion")).alias("living"),
        )
    )


# --- filters -----------------------------------------------------------------


@query("filter_predicates")
def filter_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        b.cycle_daily(spark, sf_dir)
        .where((F.col("bw") > 100) & ((F.col("cum_harvest") > 0) | (F.col("cum_depletion") > 2)))
        .select("unit", "cycle_start", "age", "cum_harvest", "cum_depletion")
    )


@query("filter_optional_range")
def filter_optional_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = b.cycle_daily(spark, sf_dir)
    return within_range(cycles, "cycle_start", dt.date(2024, 1, 8), None).select(
        "unit", "cycle_start", "age", "pop_end"
    )


@query("filter_optional_in")
def filter_optional_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = {"officer": ["BUILDING", "MACHINERY"], "manager": None, "area": ["ASIA", "EUROPE"]}
    return one_of(b.unit_dim(spark, sf_dir), choices)


@query("filter_last_n_days")
def filter_last_n_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("date").alias("event_date")
    )
    return last_n_days(events, "event_date", 7, dt.date(2024, 1, 31))


@query("dropna_subset")
def dropna_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        b.labelled_documents(spark, sf_dir)
        .select("doc_id", "lang", "quality", "toxic")
        .dropna(subset=["quality", "lang"])
    )


# --- scalar functions --------------------------------------------------------


@query("value_map")
def value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("ECONOMY", "BASIC"), ("PROMO", "OFFER"), ("BASIC", "BUDGET"), ("SMALL", None)]
    return b.table(spark, sf_dir, "part").select("p_partkey", recode("p_type", steps).alias("kind"))


NAME_RULES = [
    ("old", "aged"),
    ("red", "dark red"),
    ("dark red", "crimson"),
    ("caged", "cold"),
    ("ring", "rings"),
    ("crimson rings", " ruby rings "),
    ("gizmo", " "),
]


@query("canonicalize_names")
def canonicalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "part").select(
        "p_partkey", canonicalize("p_name", NAME_RULES).alias("name")
    )


@query("compound_key")
def compound_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_type") != "PROMO", F.col("p_type"))
    return b.table(spark, sf_dir, "part").select(
        "p_partkey", compound("p_brand", kind, "__").alias("key"), capitalize("p_type").alias("label")
    )


@query("coerce_numeric")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 2 == 1, F.replace("p_brand", F.lit("Brand#"), F.lit("")))
    return b.table(spark, sf_dir, "part").select(
        "p_partkey", to_number(F.coalesce(text, F.col("p_brand"))).alias("brand_no")
    )


@query("coerce_date")
def coerce_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in ISO and four other spellings; every third text is unreadable."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(key % 3 == 0, F.concat(day, F.lit("?")))
    for remainder, spelling in enumerate(DAY_FORMATS):
        text = text.when(key % 7 == remainder, F.date_format("o_orderdate", spelling))
    orders = b.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", to_day(text.otherwise(day), DAY_FORMATS).alias("day"))


@query("age_band")
def age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.cycle_daily(spark, sf_dir).select(
        "unit", "cycle_start", "age", age_band(_band_age()).alias("band")
    )


@query("price_band")
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = (F.col("p_retailprice") - 900) * 120 + 1000
    return b.table(spark, sf_dir, "part").select("p_partkey", price_band(price).alias("band"))


@query("calendar_parts")
def calendar_parts_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_days(spark, sf_dir).select(
        "day",
        *[c.alias(f"iso_{n}" if n == "year" else n) for n, c in calendar_parts("day").items()],
        calendar_parts("day", "calendar")["year"].alias("plain_year"),
    )


@query("week_of_month")
def week_of_month_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_days(spark, sf_dir).select("day", week_of_month("day").alias("week_of_month"))


@query("bucket_label")
def bucket_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = calendar_parts("day")
    label = bucket_label(parts["month"], parts["year"], parts["week_of_month"])
    return _order_days(spark, sf_dir).select("day", label.alias("label"))


@query("growth_rate")
def growth_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.cycle_head(spark, sf_dir).select(
        "unit",
        "cycle_start",
        growth_rate(to_number("bw_8"), to_number("bw_0")).alias("growth"),
        percent("mortality_8").alias("mortality_pct"),
    )


# --- imputation and cleansing ------------------------------------------------


@query("impute_median")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = b.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).alias("price")
    )
    return rounded(part.withColumn("price", fill_missing("price", exact_median(part, "price"))))


@query("impute_median_nan")
def impute_median_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN prices count as missing, in the median and where it fills in."""
    price = F.when(F.col("p_partkey") % 17 != 0, F.col("p_retailprice")).otherwise(float("nan"))
    part = b.table(spark, sf_dir, "part").select("p_partkey", price.alias("price"))
    filled = fill_missing("price", exact_median(part, "price"), present(part, "price"))
    return rounded(part.withColumn("price", filled))


@query("impute_mode")
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.labelled_documents(spark, sf_dir).select("doc_id", "quality", "toxic")
    return docs.withColumns(
        {name: fill_missing(name, mode_value(docs, name)) for name in ("quality", "toxic")}
    )


@query("cleanse_table")
def cleanse_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.labelled_documents(spark, sf_dir)
    rules = CleanseRules(
        fill={"toxic": 0},
        fill_with_mode=["quality"],
        drop=["source"],
        recode={"lang": {"en": "English"}},
        keep=F.col("n_chars") > 100,
    )
    return cleanse(docs, rules)


@query("drop_duplicate_rows")
def drop_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("text", "lang")
    return cleanse(docs, CleanseRules(drop_duplicates=True))


# --- windows -----------------------------------------------------------------


def _metric(spark: SparkSession, sf_dir: str, *names: str, digits: int = 6) -> DataFrame:
    days = pi.cycle_metrics(b.cycle_daily(spark, sf_dir))
    return rounded(days.select(*pi.CYCLE_DAY, *names), digits)


@query("harvest_daily")
def harvest_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "harvest_daily", "catch_age_daily")


@query("adg")
def adg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "bw", "adg")


@query("depletion_daily")
def depletion_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = pi.monitored_days(
        b.cycle_daily(spark, sf_dir), b.unit_dim(spark, sf_dir), b.monitored(spark, sf_dir)
    )
    indexed = pi.with_index(days, pi.daily_sales(b.sales(spark, sf_dir)))
    return indexed.select(*pi.CYCLE_DAY, "period", "depletion_daily")


@query("running_sum")
def running_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "catch_age_cum")


@query("running_sum_with_ties")
def running_sum_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sales of a unit on one day share the running total of that day."""
    sold = b.sales(spark, sf_dir).select("unit", "sale_date", "kg")
    week = F.trunc("sale_date", "WEEK")
    totals = blocked_running_sum(sold, "kg", ["unit"], "sale_date", week, "kg_so_far")
    return totals.withColumns({n: F.col(n).cast("double") for n in ("kg", "kg_so_far")})


@query("running_avg_filtered")
def running_avg_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    harvested = F.col("harvest") > 0
    window = by_age(pi.CYCLE, "age")
    days = pi.cycle_metrics(b.cycle_daily(spark, sf_dir)).select(
        *pi.CYCLE_DAY, "harvest_age", F.col("harvest_daily").alias("harvest")
    )
    return rounded(days.withColumn("mean_age", running_mean_where("age", harvested, window)))


@query("running_avg_colocated")
def running_avg_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``running_avg_filtered``, from a table stored by cycle: its windows need no exchange."""
    cycles = write_bucketed(b.cycle_daily(spark, sf_dir), pi.CYCLE, 16, ["age"])
    days = pi.cycle_metrics(cycles).select(*pi.CYCLE_DAY, "harvest_age", F.col("harvest_daily").alias("harvest"))
    mean = running_mean_where("age", F.col("harvest") > 0, by_age(pi.CYCLE, "age"))
    return rounded(days.withColumn("mean_age", mean))


@query("join_cycles_colocated")
def join_cycles_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a cycle with the totals of the cycle, both stored by cycle: neither side is exchanged."""
    cycles = write_bucketed(b.cycle_daily(spark, sf_dir), pi.CYCLE, 16, ["age"])
    whole = cycles.groupBy(*pi.CYCLE).agg(F.count(F.lit(1)).alias("days"), F.max("age").alias("last_age"))
    stored = write_bucketed(whole, pi.CYCLE, 16)
    joined = cycles.hint("merge").join(stored.hint("merge"), pi.CYCLE)
    return joined.select(*pi.CYCLE_DAY, "days", "last_age")


@query("fcr_calc")
def fcr_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "total_bw", "fcr_calc")


@query("performance_index_quick")
def performance_index_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "ip_quick", digits=9)


@query("running_sum_hot_groups")
def running_sum_hot_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running order value per status: each group is about a third of the table."""
    orders = b.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").cast(b.MONEY).alias("amount"),
    )
    month, year = F.trunc("day", "MONTH"), F.trunc("day", "YEAR")
    totals = blocked_running_sum(orders, "amount", ["o_orderstatus"], "day", month, "so_far", year)
    return totals.select("o_orderkey", "o_orderstatus", F.col("so_far").cast("double").alias("so_far"))


@query("delta_hot_groups")
def delta_hot_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of order value against the previous order of the same status."""
    orders = b.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast(b.MONEY).alias("amount")
    )
    key = F.col("o_orderkey")
    block, span = F.floor(key / 5000), F.floor(key / 20_000_000)
    change = blocked_delta(orders, "amount", ["o_orderstatus"], "o_orderkey", block, "change", span)
    return change.select("o_orderkey", "o_orderstatus", F.col("change").cast("double").alias("change"))


def _orders_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").cast(b.MONEY).alias("amount"),
    )


@query("scan_totals_hot_groups")
def scan_totals_hot_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum, conditional mean and extremes per status by day; each group is a third of the table."""
    dear = F.col("amount") > 150_000
    found = prefix_scan(
        _orders_by_status(spark, sf_dir),
        ["o_orderstatus"],
        "day",
        {
            "so_far": scan.total("amount"),
            "dear_mean": scan.mean_where("amount", dear),
            "least": scan.least("amount"),
            "greatest": scan.greatest("amount"),
        },
    )
    money = ["so_far", "least", "greatest"]
    return found.select("o_orderkey", "o_orderstatus", "dear_mean", *[F.col(c).cast("double").alias(c) for c in money])


@query("scan_delta_hot_groups")
def scan_delta_hot_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change against the previous order of a status, and the value of all orders before."""
    orders = _orders_by_status(spark, sf_dir)
    states = {"previous": scan.last("amount"), "earlier": scan.total("amount")}
    found = prefix_scan(orders, ["o_orderstatus"], "o_orderkey", states, before=True, unique=True)
    change = (F.col("amount") - F.col("previous")).cast("double")
    return found.select("o_orderkey", "o_orderstatus", change.alias("change"), F.col("earlier").cast("double").alias("earlier"))


@query("latest_per_cycle")
def latest_per_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = b.cycle_daily(spark, sf_dir).withColumnRenamed("unit", "unit_name")
    return latest_living(cycles, 21, dt.date(2024, 1, 31)).select(
        "unit_name", "cycle_start", "obs_date", "age", "pop_end"
    )


@query("latest_n_per_group")
def latest_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = b.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice"
    )
    return latest_n(orders, ["o_custkey"], [F.col("day").desc(), F.col("o_orderkey").desc()], 7)


@query("latest_n_hot_groups")
def latest_n_hot_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven newest orders per status: map tasks keep seven rows per group."""
    orders = b.table(spark, sf_dir, "orders").select(
        "o_orderstatus", "o_orderkey", F.col("o_orderdate").cast("date").alias("day")
    )
    return latest_n(orders, ["o_orderstatus"], [F.col("day").desc(), F.col("o_orderkey").desc()], 7)


@query("spread_ranked_rows")
def spread_ranked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = b.cycle_head(spark, sf_dir).select("hatchery", "unit", "cycle_start", "bw_8")
    newest = latest_n(heads, ["hatchery"], [F.col("cycle_start").desc(), F.col("unit").asc()], 7)
    return spread_ranked(newest, ["hatchery"], ["unit", "cycle_start", "bw_8"], 7)


# --- joins -------------------------------------------------------------------


@query("join_inner_dim")
def join_inner_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = one_of(b.unit_dim(spark, sf_dir), {"area": ["ASIA", "AFRICA", "EUROPE"]})
    cycles = b.cycle_daily(spark, sf_dir).select("unit", "cycle_start", "age", "pop_end")
    return join_renamed(cycles, require_unique(units, ["unit"]), {"unit": "unit"})


@query("join_inner_3key")
def join_inner_3key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"unit": "unit_name", "cycle_start": "start_date", "age": "day_age"}
    cycles = b.cycle_daily(spark, sf_dir).select(*pi.CYCLE_DAY, "cum_harvest")
    return join_renamed(cycles, b.monitored(spark, sf_dir), keys)


@query("join_left_2key")
def join_left_2key(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = b.cycle_daily(spark, sf_dir).select("unit", "obs_date", "age")
    sold = pi.daily_sales(b.sales(spark, sf_dir)).select("unit", "sale_date", "kg", "birds")
    joined = join_renamed(cycles, sold, {"unit": "unit", "obs_date": "sale_date"}, "left")
    return joined.select(
        "unit",
        "obs_date",
        "age",
        or_zero("kg").cast("double").alias("kg"),
        or_zero("birds").cast("long").alias("birds"),
    )


@query("actual_vs_standard")
def actual_vs_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = pi.cycle_metrics(b.cycle_daily(spark, sf_dir))
    compared = pi.with_standard(days, b.standard(spark))
    return rounded(
        compared.select(
            *pi.CYCLE_DAY,
            "bw",
            "bw_standard",
            "adg",
            "adg_standard",
            "fcr",
            "fcr_standard",
            "total_depletion",
            "mortality_standard",
        )
    )


def _noised_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = b.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key, name = F.col("c_custkey"), F.col("n_name")
    noised = (
        F.when(key % 10 == 0, F.lit(None).cast("string"))
        .when(key % 10 == 1, F.concat(F.lit("  "), F.lower(name), F.lit(" ")))
        .when(key % 10 == 2, F.concat(name, F.lit(" 2")))
        .when(key % 10 == 3, capitalize(name))
        .otherwise(name)
    )
    customers = b.table(spark, sf_dir, "customer")
    return customers.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", noised.alias("nation_text")
    )


@query("join_normalized_key")
def join_normalized_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = b.table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    return join_normalized(_noised_customers(spark, sf_dir), nations, "nation_text", "n_name")


@query("join_normalized_chain")
def join_normalized_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = b.table(spark, sf_dir, "region")
    nations = (
        b.table(spark, sf_dir, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_name", F.concat(F.lit(" "), F.lower("r_name")).alias("region_text"))
    )
    first = join_normalized(_noised_customers(spark, sf_dir), nations, "nation_text", "n_name")
    return join_normalized(first, region, "region_text", "r_name")


def _misspelt(name: Column) -> Column:
    worn = F.replace(name, F.lit("gizmo"), F.lit("gizzmo"))
    worn = F.replace(worn, F.lit("small"), F.lit("smal"))
    worn = F.replace(worn, F.lit("anvil"), F.lit("ANVIL!"))
    return F.replace(worn, F.lit("cold"), F.lit("gold"))


@query("fuzzy_topk_join")
def fuzzy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against misspelt part names, every part of both sides."""
    left = b.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    right = left.select(_misspelt(F.col("p_name")).alias("spelling"))
    return fuzzy_topk_join(left, right, "p_name", "spelling", 80, 2, dedupe_right=True)


@query("fuzzy_topk_join_copies")
def fuzzy_topk_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``fuzzy_topk``, but every copy of a right name fills a slot of its own."""
    left = b.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("s_suppkey")
    right = (
        b.table(spark, sf_dir, "supplier")
        .join(left, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.when(key % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("nation"))
    )
    return fuzzy_topk_join(left, right, "n_name", "nation", 87.5, 5)


def _long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, types and brands in one text of 60 characters and more."""
    words = F.concat_ws(" ", "p_type", "p_name", "p_brand")
    part = b.table(spark, sf_dir, "part").withColumn("words", words)
    return part.select(
        "p_partkey", F.concat_ws(" ", "words", F.lit("of part number"), "p_partkey", "words").alias("name")
    )


@query("fuzzy_topk_join_long")
def fuzzy_topk_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names too long for deletions, every part against every misspelt one."""
    left = _long_names(spark, sf_dir)
    right = left.select(_misspelt(F.col("name")).alias("spelling"))
    return fuzzy_topk_join(left, right, "name", "spelling", 95, 1, dedupe_right=True)


@query("fuzzy_topk_join_any_order")
def fuzzy_topk_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against the same names with their words reversed."""
    left = b.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    right = left.select(turned.alias("turned"))
    return fuzzy_topk_join(
        left, right, "p_name", "turned", 100, 1, dedupe_right=True, processor=sorted_words
    )


def _with_noise_words(name: Column, number: Column) -> Column:
    """The name with words left out, added or repeated, in another order."""
    words = F.split(name, " ")
    fewer = F.when(number % 3 == 0, F.slice(words, 1, F.size(words) - 1)).otherwise(F.reverse(words))
    extra = F.when(number % 4 == 1, F.array(F.lit("ltd"), words[0])).otherwise(F.array(F.lit("LTD.")))
    return F.array_join(F.concat(extra, fewer), " ")


@query("fuzzy_topk_join_word_set")
def fuzzy_topk_word_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against names of other words and order; every right name holds one word."""
    left = b.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    right = left.select(_with_noise_words(F.col("p_name"), F.col("p_partkey")).alias("noisy"))
    return fuzzy_topk_join(left, right, "p_name", "noisy", 60, 3, dedupe_right=True, scorer=WORD_SET)


@query("fuzzy_topk_join_word_part")
def fuzzy_topk_word_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``fuzzy_topk_word_set``, but extra words on either side cost nothing."""
    left = b.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    right = left.select(_with_noise_words(F.col("p_name"), F.col("p_partkey")).alias("noisy"))
    return fuzzy_topk_join(left, right, "p_name", "noisy", 75, 3, dedupe_right=True, scorer=WORD_PART)


@query("fuzzy_topk_join_prefixed")
def fuzzy_topk_prefixed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names all start alike: a hot key for piece blocking, not for deletions."""
    left = b.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    right = left.select(F.replace("s_name", F.lit("Supp"), F.lit("Sup")).alias("spelling"))
    return fuzzy_topk_join(left, right, "s_name", "spelling", 90, 3)


# --- aggregation -------------------------------------------------------------


@query("agg_sales_daily")
def agg_sales_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = pi.daily_sales(b.sales(spark, sf_dir))
    return rounded(totals.withColumns({n: F.col(n).cast("double") for n in ("kg", "amount")}))


@query("distinct_project")
def distinct_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.unit_dim(spark, sf_dir).select("officer", "manager", "area").distinct()


@query("wide_row_sum")
def wide_row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = b.wide_feed(spark, sf_dir)
    sums = row_sums(family_columns(feed.columns, b.FEED_DAYS))
    used = F.array_join(F.array_sort(used_families(family_columns(feed.columns, b.FEED_DAYS))), ",")
    return feed.select(
        "unit",
        "cycle_start",
        *[total.cast("long").alias(family) for family, total in sums.items()],
        used.alias("used"),
    )


@query("one_hot")
def one_hot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    return one_hot(b.table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", kinds, "type")


@query("one_hot_found")
def one_hot_found_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns for the kinds that are found; none is named beforehand."""
    wide, rest = one_hot_found(b.table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", ["p_partkey"], "type")
    return wide.join(rest.withColumnRenamed("value", "rest"), "p_partkey", "left")


@query("one_hot_rest")
def one_hot_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds hold most parts and get a column, the names of all other parts stay in long form."""
    key = F.col("p_partkey")
    kind = F.when(key % 2 == 0, "even").when(key % 3 == 0, "third").when(key % 5 != 0, F.col("p_name"))
    part = b.table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))
    wide, rest = one_hot_found(part, "kind", ["p_partkey"], "kind", most=2)
    return wide.join(rest.withColumnRenamed("value", "rest"), "p_partkey", "left")


# --- correlation reports -----------------------------------------------------


@query("corr_brand_hatchery")
def corr_brand_hatchery(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = b.priced_lines(spark, sf_dir)
    return brand_and_place(lines, "p_brand", "p_type", "cycle_start", "l_extendedprice")


@query("corr_brand_hatchery_by_day")
def corr_brand_hatchery_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``corr_brand_hatchery``, from cells of single days that two deliveries have stored."""
    dated = place_rows(b.priced_lines(spark, sf_dir), "p_brand", "p_type", "cycle_start", "l_extendedprice")
    cells = moments.indicator_cells(dated, PLACE_CELL, "y", [*BUCKET, "day"])
    path = scratch_path(spark, "cells")
    early = F.day("day") <= 20
    write_version(cells.where(early), path)
    write_version(cells.where(~early), path, APPEND)
    return moments.cells_correlation(read_version(spark, path), place_features())


@query("corr_amount_by_status")
def corr_amount_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of quantity and price per flag, from states of single ship days."""
    lines = b.table(spark, sf_dir, "lineitem")
    daily = moments.pair_moments(lines, ["l_returnflag", "l_shipdate"], "l_quantity", "l_extendedprice")
    merged = moments.merge_pairs(daily, ["l_returnflag"])
    return rounded(moments.pair_correlation(merged, 6).select("l_returnflag", "n", "mean_x", "mean_y", "r"))


@query("corr_brand_hatchery_mortality")
def corr_brand_hatchery_mortality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_and_place(
        b.cycle_head(spark, sf_dir),
        "doc",
        "hatchery",
        "cycle_start",
        "mortality_8",
        {"d0": "D0", "d1": "D1", "d2": "D2", "d3": "D3", "d4": "D4", "D?": None},
        [(name.lower(), name) for name in AREAS],
        outcome_is_fraction=True,
    )


@query("corr_price_band")
def corr_price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = b.priced_lines(spark, sf_dir)
    return brand_and_price(lines, "p_brand", "price", "cycle_start", "l_extendedprice")


@query("corr_feed_brand")
def corr_feed_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = b.wide_feed(spark, sf_dir)
    return feed_brands(feed, "top_feed", "cycle_start", "outcome", b.FEED_PHASES, b.FEED_DAYS)


@query("corr_pivot_report")
def corr_pivot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation_report(corr_brand_hatchery(spark, sf_dir), [1996, 1997], 5, 50)


@query("corr_pivot_full")
def corr_pivot_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year and all six weeks of a month."""
    return correlation_report(corr_brand_hatchery(spark, sf_dir), list(range(1995, 2002)))


# --- plans -------------------------------------------------------------------

AREAS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _band_age() -> Column:
    """Ages stretched over all six bands."""
    return F.col("age") * 3 + (F.col("unit") % 20).cast("int")


@query("performance_index")
def performance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship report. The cycle and monitoring bindings are unique per cycle day."""
    return rounded(
        pi.performance_index(
            b.cycle_daily(spark, sf_dir),
            b.unit_dim(spark, sf_dir),
            b.monitored(spark, sf_dir),
            b.sales(spark, sf_dir),
            b.standard(spark),
            keys_unique=True,
        )
    )


@query("performance_index_filtered")
def performance_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report with every optional filter set and the index joined by key."""
    return rounded(
        pi.performance_index(
            b.cycle_daily(spark, sf_dir),
            b.unit_dim(spark, sf_dir),
            b.monitored(spark, sf_dir),
            b.sales(spark, sf_dir),
            b.standard(spark),
            start_from=dt.date(2024, 1, 8),
            start_to=dt.date(2024, 1, 22),
            officers=["BUILDING", "MACHINERY", "HOUSEHOLD"],
            areas=["ASIA", "AFRICA", "EUROPE"],
            partnerships=["own"],
            periods=[2, 3, 4],
        )
    )


UNIT_RULES = [(" (OLD)", ""), ("UNT", "UNIT"), ("UNIT 1", "UNIT 01"), ("UNIT 010", "UNIT 10")]
MANAGER_RULES = [("NATION_1", "NATION_01"), ("NATION_010", "NATION_10"), ("NATION_2", "N_2")]


@query("population_by_age_band")
def population_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.col("unit")
    plain = F.concat(F.lit("UNIT "), unit.cast("string"))
    cycles = b.cycle_daily(spark, sf_dir).select(
        F.when(unit % 10 == 0, F.concat(F.lit(" "), F.lower(plain)))
        .when(unit % 10 == 1, F.concat(plain, F.lit(" (OLD)")))
        .when(unit % 10 == 2, F.replace(plain, F.lit("UNIT"), F.lit("UNT")))
        .otherwise(plain)
        .alias("unit_name"),
        "cycle_start",
        "obs_date",
        _band_age().alias("age"),
        "pop_end",
    )
    units = b.unit_dim(spark, sf_dir).select(
        F.concat(F.lit(" Unit "), F.col("unit").cast("string")).alias("unit_name"),
        F.when(F.col("unit") % 4 == 0, F.lower("officer")).otherwise(F.col("officer")).alias("officer"),
        "manager",
    )
    segment = F.col("c_mktsegment")
    officers = b.table(spark, sf_dir, "customer").select(
        F.concat(segment, F.lit(" ")).alias("officer"),
        F.concat(F.lit("Branch "), F.substring(segment, 1, 1)).alias("branch"),
        F.concat(F.lit("Province "), (F.length(segment) % 3).cast("string")).alias("province"),
    )
    rules = [("AUTOMOBILE", "AUTO")]
    return population_by_age_band(cycles, units, officers, UNIT_RULES, rules, MANAGER_RULES)


def _scorecard(spark: SparkSession, sf_dir: str, **choice) -> DataFrame:
    brands = {"d0": "D0", "d1": "D1", "d2": "D2", "d3": "D3", "d4": "D4", "D?": None, "-": None}
    places = [(name.lower(), name) for name in AREAS]
    heads = b.cycle_head(spark, sf_dir)
    return recent_scorecard(heads, brand_recodes=brands, place_recodes=places, **choice)


@query("recent_scorecard_brand")
def recent_scorecard_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scorecard(spark, sf_dir, kind="doc", kind_only=True)


@query("recent_scorecard_brand_hatchery")
def recent_scorecard_brand_hatchery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scorecard(spark, sf_dir, kind="doc")


@query("recent_scorecard_hatchery")
def recent_scorecard_hatchery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scorecard(spark, sf_dir, kind="doc", inplace=False)


@query("recent_scorecard_feed")
def recent_scorecard_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scorecard(spark, sf_dir, kind="feed", kind_only=True)


@query("recent_scorecard_feed_hatchery")
def recent_scorecard_feed_hatchery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scorecard(spark, sf_dir, kind="feed")


@query("recent_scorecard_feed_combination")
def recent_scorecard_feed_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scorecard(spark, sf_dir, kind="feed", inplace=False)


# --- profile -----------------------------------------------------------------


@query("profile_table")
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.profile(b.labelled_documents(spark, sf_dir))


@query("profile_merged")
def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of a table from stored states: of half of its sources first, of the others later."""
    docs = b.labelled_documents(spark, sf_dir)
    early = F.coalesce(F.pmod(F.xxhash64("source"), F.lit(2)) == 0, F.lit(True))
    path = scratch_path(spark, "profile")
    write_version(states.profile_state(docs.where(early), ["source"]), path)
    write_version(states.profile_state(docs.where(~early), ["source"]), path, APPEND)
    report = states.state_report(states.merge_states(read_version(spark, path)))
    count = F.when(F.col("is_exact"), F.col("n_distinct")).alias("n_distinct")
    return report.select("column", "row_count", "null_count", "null_pct", count, "listing", "least", "greatest")


@query("profile_duplicates")
def profile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.duplicate_rows(b.table(spark, sf_dir, "documents").select("lang", "source"))


@query("profile_duplicate_texts")
def profile_duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.duplicate_rows(b.table(spark, sf_dir, "documents").select("text"), digest=True)


@query("profile_nulls")
def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.null_counts(b.labelled_documents(spark, sf_dir))


@query("profile_low_cardinality")
def profile_low_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.low_cardinality(b.labelled_documents(spark, sf_dir))


@query("profile_boolean_candidates")
def profile_boolean_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.boolean_candidates(b.labelled_documents(spark, sf_dir))


# --- sinks -------------------------------------------------------------------


@query("sink_overwrite")
def sink_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = b.table(spark, sf_dir, "customer")
    path = scratch_path(spark, "customer")
    write_overwrite(customers, path)
    write_overwrite(customers.where(F.col("c_acctbal") > 0), path)
    return spark.read.parquet(path)


@query("sink_append")
def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = b.table(spark, sf_dir, "supplier")
    path = scratch_path(spark, "supplier")
    write_append(suppliers, path)
    write_append(suppliers.withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000), path)
    return spark.read.parquet(path)


@query("sink_sheets")
def sink_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two CSV sheets, one written twice over and then appended to, read back as one."""
    nation = b.table(spark, sf_dir, "nation")
    parts = b.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("n_nationkey"), F.col("p_name").alias("n_name")
    )
    first, second = scratch_path(spark, "nation"), scratch_path(spark, "part")
    write_sheet(nation.where(F.col("n_regionkey") == 0), first)
    write_sheet(nation, first)
    write_sheet(nation.withColumn("n_nationkey", F.col("n_nationkey") + 100), first, append=True)
    write_sheet(parts, second)
    return read_sheets(spark, {"nation": first, "part": second})


def _order_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and their lines as a change feed: the last line sets status and price."""
    orders = b.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    changes = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("o_orderstatus"),
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_extendedprice").alias("o_totalprice"),
        F.col("l_linenumber").alias("seq"),
    )
    return orders, changes


def _last_line() -> list[Column]:
    return [F.col("seq").desc(), F.col("o_totalprice").desc(), F.col("o_orderstatus").asc()]


@query("sink_upsert")
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, changes = _order_changes(spark, sf_dir)
    old, new = scratch_path(spark, "orders"), scratch_path(spark, "orders")
    write_overwrite(orders, old)
    return write_upsert(spark, old, changes, ["o_orderkey"], _last_line(), new)


@query("sink_upsert_partitions")
def sink_upsert_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, changes = _order_changes(spark, sf_dir)
    path = scratch_path(spark, "orders")
    write_overwrite(orders, path, partition_by=["o_orderstatus"])
    keys = ["o_orderstatus", "o_orderkey"]
    upsert_partitions(spark, path, changes, keys, _last_line(), ["o_orderstatus"])
    return spark.read.parquet(path)


@query("sink_upsert_null_partition")
def sink_upsert_null_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition values that look like numbers, and a NULL partition; one is left untouched."""
    status = F.col("o_orderstatus")
    part = F.when(status != "P", F.concat(F.lit("0"), F.ascii(status).cast("string")))
    old = b.table(spark, sf_dir, "orders").select(
        part.alias("part"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")
    )
    changes = old.where((F.col("k") % 3 == 0) & ~F.col("part").eqNullSafe("070")).select(
        "part", F.when(F.col("k") % 5 == 0, -F.col("k")).otherwise(F.col("k")).alias("k"), (F.col("v") + 1).alias("v")
    )
    path = scratch_path(spark, "orders")
    write_overwrite(old, path, partition_by=["part"])
    upsert_partitions(spark, path, changes, ["part", "k"], [F.col("v").desc()], ["part"])
    return spark.read.schema("k long, v double, part string").parquet(path)


@query("sink_versions_append")
def sink_versions_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a table: replaced, appended to, and the one before the last read again."""
    suppliers = b.table(spark, sf_dir, "supplier")
    path = scratch_path(spark, "supplier")
    write_version(suppliers.limit(1), path)
    write_version(suppliers, path, REPLACE_ALL)
    write_version(suppliers.withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000), path, APPEND)
    seen = [read_version(spark, path, n).withColumn("version", F.lit(n)) for n in (2, 3)]
    return seen[0].unionByName(seen[1])


@query("sink_versions_upsert")
def sink_versions_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of two of the partitions, one of them new; the version before stays readable."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    old = b.table(spark, sf_dir, "orders").select(
        F.when(month >= "1996-01", month).alias("month"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")
    )
    changes = old.where((F.col("k") % 3 == 0) & (F.col("month").isNull() | (F.col("month") < "1996-07"))).select(
        F.when(F.col("k") % 7 != 0, F.col("month")).otherwise("none").alias("month"), "k", (F.col("v") + 1).alias("v")
    )
    path = scratch_path(spark, "orders")
    write_version(old, path, partition_by=["month"])
    last = upsert_version(spark, path, changes, ["month", "k"], [F.col("v").desc()], ["month"])
    seen = [read_version(spark, path, n).withColumn("version", F.lit(n)) for n in (1, last)]
    return seen[0].unionByName(seen[1])


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = b.table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
