import datetime as dt
import math
import random
import statistics

import pytest
from broodline.functions.calendar import calendar_parts
from broodline.operators import profile as facts
from broodline.operators.aggregate import family_columns, one_hot, row_sums, used_families
from broodline.operators.association import correlation_report, indicator_correlation
from broodline.operators.cleanse import CleanseRules, booking_rules, cleanse
from broodline.operators.impute import exact_median, mode_value
from broodline.plans.brand_reports import brand_and_place, brand_and_price, feed_brands
from conftest import rows
from pyspark.sql import Observation
from pyspark.sql import functions as F


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    sxy = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True))
    sxx = sum((a - mx) ** 2 for a in x)
    syy = sum((b - my) ** 2 for b in y)
    return None if sxx == 0 or syy == 0 else sxy / math.sqrt(sxx * syy)


def test_correlation_against_definition(spark):
    rng = random.Random(5)
    data = [
        (rng.choice(["m", "n"]), rng.choice("abc"), rng.choice("xy"), rng.choice([None, 1e6 + rng.random()]))
        for _ in range(400)
    ]
    df = spark.createDataFrame(data, "bucket string, brand string, place string, y double")
    features = F.array("brand", F.concat("brand", F.lit("__"), "place"))
    found = indicator_correlation(df, ["brand", "place"], features, "y", ["bucket"], digits=9)
    got = {(r["bucket"], r["feature"]): r for r in found.collect()}
    for bucket in "mn":
        sample = [d for d in data if d[0] == bucket and d[3] is not None]
        for feature in list("abc") + [f"{b}__{p}" for b in "abc" for p in "xy"]:
            x = [1.0 if feature in (d[1], f"{d[1]}__{d[2]}") else 0.0 for d in sample]
            r = got[(bucket, feature)]
            assert (r["n"], r["n_feature"]) == (len(sample), sum(x))
            assert r["r"] == pytest.approx(pearson(x, [d[3] for d in sample]), abs=1e-7)
    assert all(-1 <= r["r"] <= 1 for r in got.values())


def test_correlation_is_null_where_undefined(spark):
    data = [
        ("constant outcome", "a", 0.1),
        ("constant outcome", "b", 0.1),
        ("constant outcome", "b", 0.1),
        ("constant feature", "a", 1.0),
        ("constant feature", "a", 2.0),
        ("single row", "a", 1.0),
        ("no outcome", "a", None),
        ("fine", "a", 1.0),
        ("fine", "b", 2.0),
        ("fine", "b", None),
    ]
    df = spark.createDataFrame(data, "bucket string, brand string, y double")
    found = indicator_correlation(df, ["brand"], F.array("brand"), "y", ["bucket"])
    assert rows(found) == [
        ("constant feature", "a", 2, 2, None),
        ("constant outcome", "a", 3, 1, None),
        ("constant outcome", "b", 3, 2, None),
        ("fine", "a", 2, 1, -1.0),
        ("fine", "b", 2, 1, 1.0),
        ("single row", "a", 1, 1, None),
    ]


def test_brand_and_place_scales_and_cuts_mortality(spark):
    data = [
        ("2022-01-03", "A", "p", "0.1"),
        ("2022-01-04", "B", "p", "0.3"),
        ("2022-01-05", "b", "q", "0.2"),
        ("2022-01-05", "B", "p", "1.5"),
        ("2022-01-05", "?", "p", "0.9"),
        ("2022-01-05", "A", None, "0.9"),
        ("2022-01-05", "A", "p", "none"),
    ]
    df = spark.createDataFrame(data, "day string, brand string, place string, m string")
    found = brand_and_place(
        df, "brand", "place", "day", "m", {"b": "B", "?": None}, outcome_is_fraction=True
    )
    got = {r["feature"]: (r["year"], r["month"], r["week_of_month"], r["n"], r["r"]) for r in found.collect()}
    assert got == {
        "A": (2022, "Jan", 2, 3, -0.866),
        "B": (2022, "Jan", 2, 3, 0.866),
        "A__p": (2022, "Jan", 2, 3, -0.866),
        "B__p": (2022, "Jan", 2, 3, 0.866),
        "B__q": (2022, "Jan", 2, 3, 0.0),
    }


def test_brand_and_price_fills_with_the_median(spark):
    data = [("A", 1000.0, 1.0), ("A", None, 2.0), ("B", 5000.0, 3.0), ("B", 13000.0, 4.0), (None, 9e9, 5.0)]
    df = spark.createDataFrame(data, "brand string, price double, bw_28 double").withColumn(
        "day", F.lit(dt.date(2022, 1, 3))
    )
    found = brand_and_price(df, "brand", "price", "day")
    assert sorted(r["feature"] for r in found.collect()) == [
        "A_ < 2000",
        "A_4000 - 6000",
        "B_4000 - 6000",
        "B_> 12000",
    ]


def test_feed_brands_parse_whole_names(spark):
    columns = ["A_1", "A_2", "AB_1", "AB_2", "s_A_1", "s_A_2", "s_AB_1", "s_AB_2", "A_3", "other"]
    families = family_columns(columns, range(1, 3))
    assert families == {
        "A": ["A_1", "A_2"],
        "AB": ["AB_1", "AB_2"],
        "s_A": ["s_A_1", "s_A_2"],
        "s_AB": ["s_AB_1", "s_AB_2"],
    }
    data = [
        (1.0, 0.0, 0.0, None, 0.0, 0.0, 0.5, 1.0, 9.0, "A", "10"),
        (0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 1.0, 1.0, 9.0, "A", "20"),
        (0.5, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 9.0, "x", "30"),
        (0.5, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 9.0, "A", "bad"),
    ]
    names = [c for c in columns if c != "other"] + ["top", "bw_28"]
    df = spark.createDataFrame(data, names).withColumn("day", F.lit("2022-01-03"))
    sums = df.select(*[c.alias(n) for n, c in row_sums(families).items()]).first()
    assert tuple(sums) == (1.0, 0.0, 0.0, 1.5)
    assert df.select(used_families(families)).first()[0] == ["A"]
    found = feed_brands(df, "top", "day", "bw_28", ["s"], range(1, 3), {"x": "B"})
    # AB is nobody's top brand, so neither AB nor s_AB is reported.
    assert sorted((r["feature"], r["n"], r["n_feature"]) for r in found.collect()) == [
        ("A", 3, 1),
        ("s_A", 3, 1),
    ]


def test_correlation_report_grid(spark):
    data = [(2021, "Jan", 1, "a", 0.5), (2022, "Dec", 5, "b", 0.1), (2022, "Dec", 6, "b", 0.2), (2020, "Jan", 1, "c", 0.3)]
    df = spark.createDataFrame(data, "year int, month string, week_of_month int, feature string, r double")
    assert len(correlation_report(df, [2021, 2022]).columns) == 145
    report = correlation_report(df, [2021, 2022], 5)
    assert len(report.columns) == 121
    found = report.collect()
    assert [r["feature"] for r in found] == ["c", "b", "a"]
    assert found[2]["Jan 21 : week 1"] == 0.5
    assert set(found[0].asDict().values()) == {"c", None}
    renamed = correlation_report(df, [2021, 2022], label_map={"a": "Z"}, descending=False)
    assert [r["feature"] for r in renamed.collect()] == ["Z", "b", "c"]
    listed = spark.createDataFrame([("a",), ("d",), (None,)], "name string")
    listed_report = correlation_report(df, [2021, 2022], features=listed)
    assert [r["feature"] for r in listed_report.collect()] == ["d", "a"]
    assert "Jan 21 : week 1" not in correlation_report(df, [2021, 2022], skip_buckets=50).columns


@pytest.mark.parametrize(
    "data",
    [
        [3.0],
        [1.0, 2.0],
        [5.0, 1.0, 1.0, 1.0],
        [-2.0, -1000.0, 0.0, 1e9, 1e-9, -1e-9],
        [7.0] * 50 + [1.0] * 49,
        [None, 4.0, None, 8.0],
    ],
)
def test_exact_median(spark, data):
    df = spark.createDataFrame([(v,) for v in data], "v double")
    found = df.select(exact_median(df, "v").alias("m")).first()[0]
    assert found == pytest.approx(statistics.median([v for v in data if v is not None]))


@pytest.mark.parametrize("shape", ["tiny", "ties", "far", "infinite"])
def test_exact_median_of_odd_shapes(spark, shape):
    """Small, repeated, far and infinite values; the bracket is far narrower than the data."""
    rng = random.Random(3)
    draw = {
        "tiny": lambda: rng.random() * 1e-6,
        "ties": lambda: float(rng.randrange(3)),
        "far": lambda: rng.choice([-1e300, 1e300]) * rng.random(),
        "infinite": lambda: rng.choice([float("-inf"), float("inf"), rng.random()]),
    }[shape]
    data = [draw() for _ in range(20_001)]
    df = spark.createDataFrame([(v,) for v in data], "v double").repartition(4)
    assert df.select(exact_median(df, "v").alias("m")).first()[0] == statistics.median(data)


@pytest.mark.parametrize("slots", [2, 16])
def test_exact_median_takes_further_rounds(spark, slots):
    """Values of one octave in more rows than a round counts singly; even counts part the ranks."""
    rng = random.Random(slots)
    data = [1 + rng.random() / 30 for _ in range(5_000)]
    for values in (data, data[1:], data + [1.01] * 2_000, data[:2_500] + [2.0] * 2_500):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        assert df.select(exact_median(df, "v", slots=slots)).first()[0] == statistics.median(values)


def test_median_is_planned_once_for_all_price_bands(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0)], "brand string, price double, bw_28 double")
    plan = brand_and_price(df.withColumn("day", F.lit(dt.date(2022, 1, 3))), "brand", "price", "day")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("scalar-subquery") <= 2


def test_exact_median_random_and_empty(spark):
    rng = random.Random(9)
    data = [rng.choice([rng.gauss(1500, 150), rng.randrange(20), -rng.expovariate(0.001)]) for _ in range(2001)]
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    assert df.select(exact_median(df, "v", slots=4)).first()[0] == statistics.median(data)
    empty = spark.createDataFrame([(None,)], "v double")
    assert empty.select(exact_median(empty, "v")).first()[0] is None


def test_mode_prefers_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,), (None,), (None,)], "v string")
    assert df.select(mode_value(df, "v")).first()[0] == "a"


def test_profile_sections(spark):
    data = [(i % 2, f"t{i % 12}", f"u{i % 13}", None if i < 3 else "x", float(i)) for i in range(26)]
    df = spark.createDataFrame(data, "flag int, twelve string, thirteen string, holes string, many double")
    got = {(r["section"], r["column"], r["metric"]): (r["value"], r["listing"]) for r in facts.profile(df).collect()}
    assert got[("table", None, "row_count")] == (26.0, None)
    assert got[("table", None, "column_count")] == (5.0, None)
    assert got[("table", None, "duplicate_rows")] == (0.0, None)
    assert got[("nulls", "holes", "null_count")] == (3.0, None)
    assert got[("nulls", "holes", "null_pct")] == (11.538, None)
    assert got[("boolean_candidates", "flag", "n_distinct")] == (2.0, "0, 1")
    listed = {c for s, c, _ in got if s == "low_cardinality"}
    assert listed == {"twelve", "holes"}
    assert got[("low_cardinality", "holes", "n_distinct")] == (1.0, "x")


@pytest.mark.parametrize("digest", [False, True])
def test_duplicates_count_rows_beyond_the_first(spark, digest):
    data = [("a", 1), ("a", 1), ("a", 1), (None, 1), (None, 1), ("1", None), (None, 11), ("a1", None)]
    df = spark.createDataFrame(data, "s string, n int")
    assert rows(facts.duplicate_rows(df, digest)) == [(8, 3, 37.5)]
    assert rows(facts.duplicate_rows(df.limit(0), digest)) == [(0, 0, None)]


def test_cleanse_bookings_and_observed_counts(spark):
    data = [
        ("9", "c1", None, "Undefined", 2),
        (None, "c2", 1, "BB", 1),
        ("9", "c3", 0, "BB", 0),
        ("7", "c4", 0, "BB", None),
        ("7", None, 0, "HB", 1),
    ]
    df = spark.createDataFrame(data, "agent string, company string, children int, meal string, adults int")
    before, after = Observation("before"), Observation("after")
    cleaned = cleanse(df, booking_rules(), before, after)
    assert cleaned.columns == ["agent", "children", "meal", "adults"]
    assert rows(cleaned) == [("7", 0, "HB", 1), ("7", 1, "BB", 1), ("9", 0, "No Meal", 2)]
    assert (before.get["row_count"], after.get["row_count"]) == (5, 3)


def test_cleanse_duplicates_and_unknown_columns(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "n int, s string")
    assert rows(cleanse(df, CleanseRules(drop_duplicates=True))) == [(1, None), (2, "a")]
    with pytest.raises(ValueError, match="agent"):
        cleanse(df, booking_rules())


def test_one_hot(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert rows(one_hot(df, "v", ["a", "b"], "is")) == [("a", 1, 0), ("b", 0, 1), (None, 0, 0)]


def test_calendar_bucket_of_new_year(spark):
    df = spark.createDataFrame([("A", "x", 1.0), ("B", "x", 2.0)], "b string, p string, y double")
    dated = df.withColumn("d", F.lit(dt.date(2022, 1, 1))).withColumns(calendar_parts("d"))
    found = indicator_correlation(dated, ["b"], F.array("b"), "y")
    assert {(r["year"], r["month"], r["week_of_month"]) for r in found.collect()} == {(2021, "Jan", 1)}


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (nan,), (nan,)], "v double")
    assert df.select(exact_median(df, "v")).first()[0] == 2.0
    assert df.select(mode_value(df, "v")).first()[0] == 1.0
    assert rows(facts.null_counts(df)) == [("v", 2, 40.0)]

