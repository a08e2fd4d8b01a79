"""Stored moments: days added one at a time equal the whole, also for values far from zero."""

import random
import statistics

import pytest
from broodline.operators import moments
from broodline.operators.association import indicator_correlation
from conftest import rows
from pyspark.sql import functions as F


def values(spark, far=0.0):
    draw = random.Random(7)
    data = []
    for k in range(900):
        x = draw.gauss(0, 1)
        y = draw.choice([None, float("nan"), far + 2 * x + draw.gauss(0, 1), far - x])
        data.append((draw.choice(["m", "n", None]), k % 30, far + x, y, draw.choice("abc"), draw.choice("xy")))
    return spark.createDataFrame(data, "g string, day int, x double, y double, brand string, place string")


@pytest.mark.parametrize("far", [0.0, 1e8])
def test_days_added_one_at_a_time_equal_the_whole(spark, far):
    df = values(spark, far)
    whole = moments.pair_moments(df, ["g"], "x", "y")
    by_day = moments.merge_pairs(moments.pair_moments(df, ["g", "day"], "x", "y"), ["g"])
    step = moments.pair_moments(df.where("day = 0"), ["g"], "x", "y")
    for low, high in ((1, 5), (5, 6), (6, 30)):
        new = moments.pair_moments(df.where(f"day >= {low} and day < {high}"), ["g"], "x", "y")
        step = moments.merge_pairs(step.unionByName(new), ["g"])
    results = [{r["g"]: r for r in moments.pair_correlation(s, 9).collect()} for s in (whole, by_day, step)]
    for group in ("m", "n", None):
        seen = [(r.x, r.y) for r in df.where(F.col("g").eqNullSafe(group)).collect() if r.y is not None and r.y == r.y]
        for found in results:
            r = found[group]
            assert r["n"] == len(seen)
            assert r["r"] == pytest.approx(statistics.correlation(*zip(*seen, strict=True)), abs=1e-6)
            assert r["mean_x"] == pytest.approx(statistics.fmean(x for x, _ in seen))


def test_cells_give_the_report(spark):
    df = values(spark, 1e6)
    features = F.array("brand", F.concat("brand", F.lit("__"), "place"))
    wanted = indicator_correlation(df.where("g is not null"), ["brand", "place"], features, "y", ["g"])
    cells = moments.indicator_cells(df.where("g is not null"), ["brand", "place"], "y", ["g", "day"])
    assert rows(moments.cells_correlation(cells, features, ["g"])) == rows(wanted.select("g", "feature", "n", "n_feature", "r"))
    merged = moments.merge_cells(cells, ["g", "brand", "place"])
    assert merged.count() < cells.count() / 5
    assert rows(moments.cells_correlation(merged, features, ["g"])) == rows(moments.cells_correlation(cells, features, ["g"]))


def test_undefined_and_empty(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("none", None, 1.0)], "g string, x double, y double")
    found = moments.pair_correlation(moments.merge_pairs(moments.pair_moments(df, ["g"], "x", "y"), ["g"]))
    assert rows(found.select("g", "n", "r")) == [("flat", 2, None), ("one", 1, None)]
    assert moments.merge_pairs(moments.pair_moments(df.limit(0), ["g"], "x", "y"), ["g"]).collect() == []
    assert moments.cells_correlation(moments.indicator_cells(df.limit(0), ["g"], "y", ["x"]), F.array("g"), ["x"]).collect() == []
