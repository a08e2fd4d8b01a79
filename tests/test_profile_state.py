"""Profile states: any split merges to the whole, counts are exact below their bound, odd columns have defined results."""

import pytest
from broodline.operators.profile import small_domains
from broodline.operators.profile_state import EXACT, ITEMS, merge_states, profile_state, state_report
from conftest import rows
from pyspark.sql import functions as F

EXACT_COLUMNS = ["position", "column", "type", "row_count", "null_count", "null_pct", "n_distinct", "listing", "least", "greatest"]


def numbers(spark, size=6000):
    return spark.range(0, size, 1, 4).select(
        "id",
        (F.col("id") % 12).cast("string").alias("twelve"),
        (F.col("id") % 13).cast("string").alias("thirteen"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("flag"),
        (F.col("id") % (EXACT - 1)).cast("double").alias("most"),
        F.when(F.col("id") % 3 == 0, float("nan")).otherwise(-F.col("id") / 7).alias("real"),
        F.xxhash64("id").cast("decimal(38,2)").alias("money"),
        (F.col("id") % 90).cast("int").alias("ninety"),
    )


@pytest.mark.parametrize("split", [1, 2, 17])
def test_merged_parts_equal_the_whole(spark, split):
    df = numbers(spark)
    whole = state_report(merge_states(profile_state(df)))
    parts = df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(split)))
    merged = merge_states(profile_state(parts, ["part"]))
    assert rows(state_report(merged).select(*EXACT_COLUMNS)) == rows(whole.select(*EXACT_COLUMNS))
    again = merge_states(merge_states(profile_state(parts, ["part"])))
    assert rows(state_report(again).select(*EXACT_COLUMNS)) == rows(whole.select(*EXACT_COLUMNS))


def test_facts_are_those_of_the_rows(spark):
    found = {r["column"]: r for r in state_report(merge_states(profile_state(numbers(spark)))).collect()}
    assert (found["twelve"]["n_distinct"], found["thirteen"]["n_distinct"]) == (12, 13)
    assert found["twelve"]["listing"] == ", ".join(sorted(map(str, range(12)))) and found["thirteen"]["listing"] is None
    assert (found["flag"]["null_count"], found["flag"]["null_pct"], found["flag"]["listing"]) == (1200, 20.0, "0, 1")
    assert (found["most"]["n_distinct"], found["most"]["is_exact"]) == (EXACT - 1, True)
    assert found["id"]["n_distinct"] >= EXACT and not found["id"]["is_exact"]
    assert (found["id"]["least"], found["id"]["greatest"]) == ("0", "5999")
    assert found["real"]["null_count"] == 2000 and float(found["real"]["least"]) == pytest.approx(-5999 / 7)
    assert found["id"]["quantiles"] == pytest.approx([1500, 3000, 4500], abs=150)
    assert found["twelve"]["quantiles"] is None


def test_extremes_follow_the_type_after_a_merge(spark):
    df = spark.createDataFrame(
        [(1, 9, 9.5, "9"), (1, 100, -2.0, "10"), (2, -30, 1e10, None), (2, None, None, "é")],
        "part int, a int, b double, c string",
    )
    found = {r["column"]: (r["least"], r["greatest"]) for r in merge_states(profile_state(df, ["part"])).collect()}
    assert found == {"a": ("-30", "100"), "b": ("-2.0", "1.0E10"), "c": ("10", "é")}


def test_odd_columns_and_empty_tables(spark):
    df = spark.createDataFrame(
        [({"a": 1}, [1, 2], None, "x" * 100_000, True), (None, [], None, "", None)],
        "m map<string,int>, l array<int>, nothing string, `long text` string, `rows` boolean",
    )
    found = {r["column"]: r for r in state_report(merge_states(profile_state(df))).collect()}
    assert (found["m"]["null_count"], found["m"]["n_distinct"], found["m"]["least"]) == (1, 1, None)
    assert found["l"]["n_distinct"] == 2
    assert (found["nothing"]["null_count"], found["nothing"]["n_distinct"], found["nothing"]["listing"]) == (2, 0, None)
    assert found["long text"]["listing"] == ", " + "x" * 100_000
    assert found["rows"]["listing"] == "true"
    empty = state_report(merge_states(profile_state(df.limit(0)))).collect()
    assert {(r["row_count"], r["null_count"], r["n_distinct"], r["null_pct"]) for r in empty} == {(0, 0, 0, None)}
    assert merge_states(profile_state(df.limit(0), ["nothing"])).collect() == []
    with pytest.raises(ValueError, match="rename"):
        profile_state(df, ["rows"])
    with pytest.raises(ValueError, match="can be listed"):
        state_report(merge_states(profile_state(df)), below=ITEMS)


@pytest.mark.parametrize("below", [1, 2, 13, 64, 200, 1000])
def test_small_domains_are_decided_exactly(spark, below):
    """Columns of just fewer, as many, and more distinct values than asked for."""
    sizes = {f"c{d}": max(1, below + d) for d in (-2, -1, 0, 1, 40)}
    df = spark.range(0, 5_000, 1, 4).select(*[(F.col("id") % n).cast("string").alias(c) for c, n in sizes.items()])
    found = small_domains(df, dict.fromkeys(sizes, below))
    wanted = {c: n for c, n in sizes.items() if n < below}
    assert {r["column"]: r["n_distinct"] for r in found.collect()} == wanted
