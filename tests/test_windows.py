import datetime as dt
import random

import pytest
from broodline.operators.windows import (
    blocked_delta,
    blocked_running_sum,
    by_age,
    delta,
    latest_n,
    running_mean_where,
    running_sum,
    spread_ranked,
)
from broodline.plans.age_bands import latest_living
from conftest import rows
from pyspark.sql import functions as F

CYCLE = ["unit", "cycle_start"]


@pytest.fixture(scope="module")
def cycles(spark):
    data = [("a", 1, 1, 0), ("a", 1, 2, 3), ("a", 1, 5, 3), ("a", 2, 1, 7), ("a", 2, 2, 9)]
    return spark.createDataFrame(data, "unit string, cycle_start int, age int, x int")


def test_delta_is_null_on_first_day_of_each_cycle(cycles):
    found = cycles.select(*CYCLE, "age", delta("x", by_age(CYCLE, "age")).alias("d"))
    assert rows(found) == [
        ("a", 1, 1, None),
        ("a", 1, 2, 3),
        ("a", 1, 5, 0),
        ("a", 2, 1, None),
        ("a", 2, 2, 2),
    ]


def test_running_sum_includes_peers(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 4)], "k string, age int, x int")
    found = df.select("age", "x", running_sum("x", by_age(["k"], "age")))
    assert rows(found) == [(1, 1, 3), (1, 2, 3), (2, 4, 7)]


def test_running_mean_where(cycles):
    mean = running_mean_where("age", F.col("x") > 0, by_age(CYCLE, "age"))
    found = cycles.select("cycle_start", "age", mean)
    assert rows(found) == [(1, 1, None), (1, 2, 2.0), (1, 5, 3.5), (2, 1, 1.0), (2, 2, 1.5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_blocked_forms_equal_plain_windows(spark, seed):
    rng = random.Random(seed)
    data = []
    for i in range(3000):
        # One key holds most rows; ties, NULL keys and NULL values occur.
        key = "hot" if rng.random() < 0.7 else rng.choice(["b", "c", None])
        data.append((i, key, rng.randrange(200), rng.choice([None, rng.randrange(100)])))
    df = spark.createDataFrame(data, "id int, k string, t int, x int")
    block = F.floor(F.col("t") / 7)
    blocked = blocked_running_sum(df, "x", ["k"], "t", block, "s").select("id", "s")
    plain = df.select("id", running_sum("x", by_age(["k"], "t")))
    assert rows(blocked) == rows(plain)
    span = F.floor(F.col("t") / 28)
    blocked = blocked_running_sum(df, "x", ["k"], "t", block, "s", span).select("id", "s")
    assert rows(blocked) == rows(plain)
    by_id = F.floor(F.col("id") / 100)
    blocked = blocked_delta(df, "x", ["k"], "id", by_id, "d").select("id", "d")
    plain = df.select("id", delta("x", by_age(["k"], "id")))
    assert rows(blocked) == rows(plain)
    span = F.floor(F.col("id") / 700)
    blocked = blocked_delta(df, "x", ["k"], "id", by_id, "d", span).select("id", "d")
    assert rows(blocked) == rows(plain)


def test_latest_n_and_spread(spark):
    data = [("p", dt.date(2024, 1, 1 + i // 2), i) for i in range(9)]
    data += [("q", dt.date(2024, 1, 1), 100), ("q", None, 101)]
    df = spark.createDataFrame(data, "k string, d date, id int")
    newest = latest_n(df, ["k"], [F.col("d").desc(), F.col("id").asc()], 7)
    wide = spread_ranked(newest, ["k"], ["id"], 7)
    assert rows(wide) == [
        ("p", 8, 6, 7, 4, 5, 2, 3),
        ("q", 100, 101, None, None, None, None, None),
    ]


def test_latest_living_filters_after_ranking(spark):
    data = [
        ("a", 1, 1, 50, dt.date(2024, 1, 1)),
        ("a", 1, 2, 0, dt.date(2024, 1, 2)),
        ("b", 1, 1, 9, dt.date(2024, 1, 1)),
        ("b", 2, 1, 8, dt.date(2024, 1, 9)),
    ]
    df = spark.createDataFrame(
        data, "unit_name string, cycle_start int, age int, pop_end int, obs_date date"
    )
    assert [r[0:2] for r in rows(latest_living(df))] == [("b", 1), ("b", 2)]
    recent = latest_living(df, 3, dt.date(2024, 1, 10))
    assert [r[0:2] for r in rows(recent)] == [("b", 2)]
