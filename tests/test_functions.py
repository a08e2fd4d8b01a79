import datetime as dt

import pytest
from broodline.functions.calendar import bucket_headings, bucket_label, calendar_parts, week_of_month
from broodline.functions.numeric import (
    age_band,
    growth_rate,
    percent,
    price_band,
    used_flag,
    zero_guarded_ratio,
)
from broodline.functions.text import (
    canonicalize,
    capitalize,
    collapse_recodes,
    compound,
    normalized_key,
    recode,
    DAY_FORMATS,
    to_day,
    to_number,
)
from broodline.operators.filters import last_n_days, one_of, within_range
from pyspark.sql import functions as F


def values(spark, schema, data, *columns):
    df = spark.createDataFrame(data, schema).coalesce(1)
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def test_canonicalize_applies_rules_in_order(spark):
    rules = [("N FARM", "NORTH FARM"), ("A 1", "A"), ("FARM A", "FARM A 1"), ("JO", "JOE")]
    data = [(" N FARM A 1 ",), ("NORTH FARM A",), ("JO",), ("JOE",), (None,)]
    assert values(spark, "name string", data, canonicalize("name", rules)) == [
        "NORTH FARM A 1",
        "NORTH FARM A 1",
        "JOE",
        "JOEE",
        None,
    ]


def test_canonicalize_whole_values(spark):
    rules = [("JO", "JOE"), ("JOE", "JOSEPH ")]
    data = [("JO",), ("JOE",), ("JO ANN",)]
    found = values(spark, "name string", data, canonicalize("name", rules, whole_value=True))
    assert found == ["JOSEPH", "JOSEPH", "JO ANN"]


def test_recode_is_whole_value_and_sequential(spark):
    steps = [("A", "B"), ("B", "C"), ("x", None)]
    assert collapse_recodes(steps) == {"A": "C", "B": "C", "x": None}
    assert collapse_recodes([("A", None), ("B", "A")]) == {"A": None, "B": "A"}
    data = [("A",), ("B",), ("AB",), ("x",), (None,)]
    assert values(spark, "v string", data, recode("v", steps)) == ["C", "C", "AB", None, None]
    assert values(spark, "v string", data, recode("v", [])) == ["A", "B", "AB", "x", None]


def test_text_keys(spark):
    data = [(" abc ", "x"), ("ABC", None), (None, "y")]
    found = values(
        spark,
        "a string, b string",
        data,
        normalized_key("a"),
        compound("a", "b", "__"),
        capitalize("a"),
    )
    assert found == [("ABC", " abc __x", " abc "), ("ABC", None, "Abc"), (None, None, None)]


def test_to_number_takes_numbers_only(spark):
    data = [("12",), (" 1.5 ",), ("-.5e2",), ("12d",), ("abc",), ("",), (None,), ("1,5",)]
    assert values(spark, "v string", data, to_number("v")) == [
        12.0,
        1.5,
        -50.0,
        None,
        None,
        None,
        None,
        None,
    ]


def test_to_day_spellings_and_strict(spark):
    data = [("2021-01-06",), ("2021/1/6",), ("6 Jan 2021",), (" ",), (None,)]
    day = dt.date(2021, 1, 6)
    assert values(spark, "v string", data, to_day("v", DAY_FORMATS, strict=True)) == [day, day, day, None, None]
    with pytest.raises(Exception, match="not a day"):
        values(spark, "v string", [("soon",)], to_day("v", DAY_FORMATS, strict=True))


def test_to_day(spark):
    data = [("2024-02-29",), ("2024-02-30",), ("zz",), (None,), ("2024-01-05 10:00:00",)]
    assert values(spark, "v string", data, to_day("v")) == [
        dt.date(2024, 2, 29),
        None,
        None,
        None,
        dt.date(2024, 1, 5),
    ]


def test_calendar(spark):
    data = [
        (dt.date(2021, 12, 31),),
        (dt.date(2022, 1, 1),),
        (dt.date(2022, 1, 3),),
        (dt.date(2022, 1, 31),),
        (dt.date(2024, 2, 29),),
        (None,),
    ]
    parts = calendar_parts("d")
    found = values(spark, "d date", data, *parts.values())
    assert found == [
        (52, "Dec", 2021, 5),
        (52, "Jan", 2021, 1),
        (1, "Jan", 2022, 2),
        (5, "Jan", 2022, 6),
        (9, "Feb", 2024, 5),
        (None, None, None, None),
    ]
    plain = values(spark, "d date", data, calendar_parts("d", "calendar")["year"])
    assert plain == [2021, 2022, 2022, 2022, 2024, None]
    label = bucket_label(parts["month"], parts["year"], week_of_month("d"))
    assert values(spark, "d date", data, label)[1] == "Jan 21 : week 1"
    with pytest.raises(ValueError):
        calendar_parts("d", "fiscal")


def test_bucket_headings():
    assert len(bucket_headings([2021, 2022])) == 144
    assert len(bucket_headings([2021, 2022], 5)) == 120
    assert bucket_headings([2021, 2022], 5, skip=50)[0] == "Nov 21 : week 1"


def test_age_band_edges(spark):
    ages = [1, 7, 8, 14, 15, 21, 22, 28, 29, 35, 36, None]
    bands = ["w1", "w1", "w2", "w2", "w3", "w3", "w4", "w4", "w5", "w5", "w6", None]
    assert values(spark, "a int", [(a,) for a in ages], age_band("a")) == bands


def test_price_band_edges(spark):
    prices = [None, 1999.0, 2000.0, 3999.99, 9999.0, 10000.0, 12000.0, 12001.0]
    assert values(spark, "p double", [(p,) for p in prices], price_band("p")) == [
        None,
        " < 2000",
        "2000 - 4000",
        "2000 - 4000",
        "8000 - 10000",
        "10000 - 12000",
        "10000 - 12000",
        "> 12000",
    ]


def test_used_flag(spark):
    data = [(0.0,), (0.5,), (1.0,), (1.5,), (2.0,), (None,)]
    assert values(spark, "x double", data, used_flag("x")) == [0, 0, 1, 0, 1, 0]


def test_optional_filters(spark):
    today = dt.date.today()
    data = [(today, "a"), (today - dt.timedelta(days=30), "b"), (None, None)]
    df = spark.createDataFrame(data, "d date, v string")
    assert last_n_days(df, "d", None).count() == 3
    assert last_n_days(df, "d", 7).count() == 1
    assert last_n_days(df, "d", 30, F.lit(today)).count() == 2
    assert within_range(df, "d").count() == 3
    assert within_range(df, "d", upper=today - dt.timedelta(days=1)).count() == 1
    assert one_of(df, {"v": None}).count() == 3
    assert one_of(df, {"v": ["a", "c"], "d": None}).count() == 1


def test_guards(spark):
    data = [(6.0, 3.0), (6.0, 0.0), (6.0, None), (None, 2.0)]
    ratio = zero_guarded_ratio(F.col("a"), F.col("b"))
    found = values(spark, "a double, b double", data, ratio, growth_rate("a", "b"))
    assert found == [(2.0, 2.0), (0.0, None), (None, None), (None, None)]
    assert values(spark, "m double", [(0.123456,)], percent("m")) == [12.3456]
