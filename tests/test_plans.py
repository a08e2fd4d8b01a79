import datetime as dt

import pytest
from broodline.operators.joins import join_renamed
from broodline.plans import performance_index as pi
from broodline.plans.age_bands import population_by_age_band
from broodline.plans.registry import QUERIES
from broodline.plans.scorecards import recent_scorecard
from conftest import rows
from pyspark.sql import functions as F

DAY = dt.date(2024, 1, 1)


def cycle_rows(spark, data):
    schema = (
        "unit int, cycle_start date, obs_date date, age int, initial_pop long, pop_end long,"
        " cum_depletion long, cum_harvest long, cum_feed double, bw double, fcr double,"
        " total_depletion double"
    )
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def inputs(spark):
    cycles = cycle_rows(
        spark,
        [
            (1, DAY, DAY, 1, 100, 100, 0, 0, 5.0, 40.0, 1.1, 0.0),
            (1, DAY, dt.date(2024, 1, 2), 2, 100, 88, 2, 10, 10.0, 80.0, 1.2, 2.0),
            (1, DAY, dt.date(2024, 1, 4), 4, 100, 88, 2, 10, 0.0, 0.0, 1.3, 2.0),
            (2, DAY, DAY, 1, 50, 0, 50, 0, 5.0, 40.0, 1.0, 100.0),
        ],
    )
    units = spark.createDataFrame(
        [(1, "o", "m", "a"), (2, "o", "m", "b")], "unit int, officer string, manager string, area string"
    )
    watched = cycles.select(
        F.col("unit").alias("unit_name"),
        F.col("cycle_start").alias("start_date"),
        F.col("age").alias("day_age"),
        F.lit(1).alias("period"),
    )
    sales = spark.createDataFrame(
        [
            (1, dt.date(2024, 1, 2), 3.0, 6, 60.0),
            (1, dt.date(2024, 1, 2), 5.0, 4, 100.0),
            (1, dt.date(2024, 1, 2), 0.0, 9, 0.0),
        ],
        "unit int, sale_date date, kg double, birds int, amount double",
    )
    standard = spark.createDataFrame(
        [(1, 0.041, 0.0, 1.0, 0.01), (2, 0.08, 0.04, 1.1, 0.02)],
        "age int, bw_std double, adg_std double, fcr_std double, mortality_std double",
    )
    return cycles, units, watched, sales, standard


def test_metrics_guard_zero_denominators(inputs):
    got = {(r["unit"], r["age"]): r for r in pi.cycle_metrics(inputs[0]).collect()}
    assert got[(1, 1)]["harvest_daily"] is None and got[(1, 1)]["catch_age_daily"] is None
    assert got[(1, 1)]["harvest_age"] == 1.0
    assert (got[(1, 2)]["harvest_daily"], got[(1, 2)]["catch_age_daily"]) == (10, 20)
    assert got[(1, 4)]["total_bw"] == 0 and got[(1, 4)]["fcr_calc"] == 0 and got[(1, 4)]["ip_quick"] == 0
    assert got[(1, 4)]["catch_age_daily"] == 0 and got[(1, 4)]["catch_age_cum"] == 20
    assert got[(2, 1)]["total_bw"] == 0.0 and got[(2, 1)]["fcr_calc"] == 0


def test_performance_index_by_hand(inputs):
    report = pi.performance_index(*inputs)
    assert report.columns == pi.REPORT
    got = {(r["unit"], r["age"]): r for r in report.collect()}
    # Day 2: 8 kg sold, 88 * 80 / 1000 = 7.04 kg alive, 98 birds not depleted.
    total_kg, living = 15.04, 98
    survival = 98 / 100
    weight = total_kg / living * 1000
    conversion = 10.0 / total_kg
    mean_age = (2 * 10 + 2 * 9 * 0 + 2 * 88) / living
    assert got[(1, 2)]["ip"] == pytest.approx(survival * weight / (conversion * mean_age) * 10)
    assert got[(1, 4)]["ip"] is None and got[(1, 4)]["bw_standard"] is None
    assert got[(2, 1)]["ip"] is None
    assert got[(1, 1)]["bw_standard"] == pytest.approx(41.0)
    assert got[(1, 2)]["mortality_standard"] == pytest.approx(2.0)


def test_both_report_forms_agree_on_unique_keys(inputs):
    single = pi.performance_index(*inputs, keys_unique=True)
    assert rows(single) == rows(pi.performance_index(*inputs))


def test_repeated_days_repeat_in_the_joined_form(inputs):
    cycles, units, watched, sales, standard = inputs
    twice = watched.unionAll(watched.where(F.col("day_age") == 1))
    report = pi.performance_index(cycles, units, twice, sales, standard)
    assert report.where((F.col("unit") == 1) & (F.col("age") == 1)).count() == 4


def test_optional_filters(inputs):
    assert pi.performance_index(*inputs, areas=["b"]).count() == 1
    assert pi.performance_index(*inputs, start_from=dt.date(2024, 1, 2)).count() == 0
    assert pi.performance_index(*inputs, unit_names=[1], periods=[1], officers=["o"]).count() == 3


def test_population_keeps_unmatched_units_and_skips_old_bands(spark):
    cycles = spark.createDataFrame(
        [
            ("u1 ", DAY, DAY, 3, 10),
            ("U1", DAY, DAY, 20, 5),
            ("U1", dt.date(2023, 12, 1), DAY, 36, 7),
            ("ghost", DAY, DAY, 8, 2),
            ("dead", DAY, DAY, 8, 0),
        ],
        "unit_name string, cycle_start date, obs_date date, age int, pop_end int",
    )
    units = spark.createDataFrame(
        [(" U1", "ann  ", "OLD NAME")], "unit_name string, officer string, manager string"
    )
    officers = spark.createDataFrame(
        [("ANN", "b1", "p1"), ("ANN", "b1", "p1")], "officer string, branch string, province string"
    )
    found = population_by_age_band(cycles, units, officers, manager_rules=[("OLD NAME", "NEW NAME")])
    assert [tuple(r) for r in found.collect()] == [
        ("p1", "b1", "NEW NAME", 10, 0, 5, 0, 15),
        (None, None, None, 0, 2, 0, 0, 2),
    ]


def test_scorecard_variants(spark):
    data = [
        (i, dt.date(2024, 1, 1 + i), "A" if i % 2 else "a", "norhill", "f", 0.01 * i, "40", "100")
        for i in range(9)
    ]
    data += [(50, DAY, "B", None, None, 0.1, "0", "x"), (51, DAY, "B", "Westmere", "g", 2.0, "40", "90")]
    heads = spark.createDataFrame(
        data,
        "unit int, cycle_start date, doc string, hatchery string, feed string,"
        " mortality_8 double, bw_0 string, bw_8 string",
    )

    def card(**choice):
        return recent_scorecard(
            heads, brand_recodes={"a": "A"}, place_recodes={"norhill": "Norhill"}, **choice
        )

    both = card().collect()
    assert [r["grp"] for r in both] == ["A_Norhill"]
    assert [both[0][f"unit_{i}"] for i in range(1, 8)] == [8, 7, 6, 5, 4, 3, 2]
    assert (both[0]["mortality_8_1"], both[0]["growth_1"]) == (8.0, 2.5)
    assert sorted(r["grp"] for r in card(kind_only=True).collect()) == ["A"]
    assert sorted(r["grp"] for r in card(inplace=False).collect()) == ["Norhill"]
    feed = {r["grp"]: r for r in card(kind="feed").collect()}
    assert set(feed) == {"f_Norhill", "g_Westmere"}
    assert feed["g_Westmere"]["mortality_8_1"] == 2.0 and feed["g_Westmere"]["unit_2"] is None
    assert sorted(r["grp"] for r in card(kind="feed", kind_only=True).collect()) == ["f", "g"]
    assert sorted(r["grp"] for r in card(kind="feed", inplace=False).collect()) == ["Norhill", "Westmere"]
    with pytest.raises(ValueError):
        card(kind="water")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_rows_and_no_cross_products(spark, sf_dir, key):
    if key.startswith("sink"):
        pytest.skip("writes when built")
    plan = physical(QUERIES[key](spark, sf_dir))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


@pytest.mark.parametrize("key", ["latest_per_cycle", "latest_n_hot_groups", "recent_scorecard_brand", "fuzzy_topk_join"])
def test_rank_limits_run_before_the_shuffle(spark, sf_dir, key):
    assert "WindowGroupLimit" in physical(QUERIES[key](spark, sf_dir))


def test_cycle_windows_share_one_exchange(inputs):
    plan = physical(pi.cycle_metrics(inputs[0]))
    assert plan.count("Exchange hashpartitioning") == 1


def test_dimension_joins_sort_merge_beyond_the_broadcast_limit(spark, inputs):
    cycles, units = inputs[0], inputs[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in physical(join_renamed(cycles, units, {"unit": "unit"}))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_date_range_reaches_the_scan(spark, inputs, tmp_path):
    """A stored cycle start is filtered where the cycles are read, below the windows."""
    cycles, units, watched, _, _ = inputs
    cycles.write.parquet(f"{tmp_path}/cycles")
    stored = spark.read.parquet(f"{tmp_path}/cycles")
    plan = physical(pi.monitored_days(stored, units, watched, start_from=DAY, start_to=DAY))
    assert "GreaterThanOrEqual(cycle_start,2024-01-01)" in plan


def test_repeated_cycle_days_meet_every_index_of_their_day(spark, inputs):
    """As the join by key would: two rows of one day, one of them without an index."""
    cycles, units, watched, sales, standard = inputs
    twice = cycles.union(cycles.where("unit = 1 AND age = 2").withColumn("bw", F.lit(0.0)))
    found = pi.performance_index(twice, units, watched, sales, standard)
    day = found.where("unit = 1 AND age = 2").select("bw_actual", "ip").collect()
    assert len(day) == 2
    assert len({r["ip"] for r in day}) == 1 and day[0]["ip"] is not None


@pytest.mark.parametrize("key", ["running_avg_colocated", "join_cycles_colocated"])
def test_tables_stored_by_cycle_need_no_exchange(spark, sf_dir, key):
    plan = QUERIES[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
