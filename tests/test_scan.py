"""Running states against brute force, over one and many ranges, with ties and NULLs; found values for one-hot columns."""

import random

import pytest
from broodline.operators import scan
from broodline.operators.aggregate import frequent_values, one_hot_found
from broodline.operators.scan import prefix_scan
from conftest import rows
from pyspark.sql import functions as F


def brute(data, before, unique):
    """Per row: sum, mean of even values, least, greatest and newest value of the rows up to it or before it."""
    out = []
    place = lambda o: (o is not None, o or 0)
    for key, order, value in data:
        seen = [(o, v) for k, o, v in data if k == key and (place(o) < place(order) if before else place(o) <= place(order))]
        found = [v for _, v in seen if v is not None]
        even = [v for v in found if v % 2 == 0]
        newest = max(seen, key=lambda s: place(s[0]))[1] if seen and unique else None
        out.append(
            (key, order, value, sum(found) if found else None, sum(even) / len(even) if even else None,
             min(found, default=None), max(found, default=None), newest)
        )
    return sorted(out, key=repr)


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("unique", [False, True])
@pytest.mark.parametrize("ranges", [1, 9])
def test_scan_equals_brute_force(spark, before, unique, ranges):
    draw = random.Random(f"{before}{unique}")
    data = []
    for key, size in (("hot", 160), ("b", 30), (None, 20), ("single", 1)):
        orders = draw.sample([None, *range(400)], size) if unique else [draw.choice([None, *range(40)]) for _ in range(size)]
        data += [(key, o, draw.choice([None, *range(-9, 10)])) for o in orders]
    draw.shuffle(data)
    df = spark.createDataFrame(data, "k string, o long, v long").repartition(4)
    states = {
        "total": scan.total("v"), "mean": scan.mean_where("v", F.col("v") % 2 == 0),
        "low": scan.least("v"), "high": scan.greatest("v"),
    }
    if unique:
        states["newest"] = scan.last("v")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        found = prefix_scan(df, ["k"], "o", states, before, unique)
        assert found.columns == [*df.columns, *states]
        if not unique:
            found = found.withColumn("newest", F.lit(None))
        assert rows(found) == brute(data, before, unique)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_scan_of_no_rows_and_odd_states(spark):
    df = spark.createDataFrame([], "k string, o long, v long")
    assert prefix_scan(df, ["k"], "o", {"t": scan.total("v")}).collect() == []
    with pytest.raises(ValueError, match="no way to join"):
        prefix_scan(df, ["k"], "o", {"t": scan.State((F.col("v"),), ("product",))})


def test_hot_group_is_read_by_many_tasks(spark):
    df = spark.range(0, 8000, 1, 4).select(F.lit("hot").alias("k"), "id", (F.col("id") % 7).alias("v"))
    found = prefix_scan(df, ["k"], "id", {"t": scan.total("v")}, unique=True)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2500
    assert found.where("id = 7999").first()["t"] == sum(k % 7 for k in range(8000))


def test_found_values(spark):
    data = [(k, "a" if k % 2 else ("b" if k % 4 else f"v{k}")) for k in range(4000)] + [(-1, None), (-2, "")]
    df = spark.createDataFrame(data, "id long, kind string").repartition(4)
    assert frequent_values(df, "kind", 2) == [("a", 2000), ("b", 1000)]
    wide, rest = one_hot_found(df, "kind", ["id"], "kind", 2)
    assert wide.columns == ["id", "kind", "kind_a", "kind_b", "kind__rest"]
    assert tuple(wide.agg(F.sum("kind_a"), F.sum("kind_b"), F.sum("kind__rest")).first()) == (2000, 1000, 1001)
    assert rest.count() == 1001 and rest.where("value = ''").count() == 1
    few = df.where("id % 4 <> 0 or id < 8")
    wide, rest = one_hot_found(few, "kind", ["id"], "kind")
    assert wide.columns[2:] == ["kind_", "kind_a", "kind_b", "kind_v0", "kind_v4", "kind__rest"]
    assert rest.collect() == [] and wide.where("id = -1").first()[2:] == (0, 0, 0, 0, 0, 0)
    wide, rest = one_hot_found(df.limit(0), "kind", ["id"], "kind")
    assert wide.columns == ["id", "kind", "kind__rest"] and rest.collect() == []
