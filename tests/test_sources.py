import tempfile

import pytest
from broodline.plans.bindings import COLUMNS, table
from broodline.plans.intake import intake
from broodline.sources.scratch import scratch_path
from broodline.sources.sinks import (
    merge_upsert,
    newest_changes,
    upsert_partitions,
    upsert_statement,
    write_append,
    write_overwrite,
    write_sheet,
    write_upsert,
)
from broodline.sources.tables import (
    catalog_table,
    jdbc_options,
    read_sheets,
    read_table,
    register_views,
    union_tagged,
)
from conftest import rows
from pyspark.sql import functions as F


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-")


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")


@pytest.fixture(scope="module")
def changes(spark):
    data = [(2, "old", 1), (2, "new", 2), (4, "d", 1), (3, None, 5)]
    return spark.createDataFrame(data, "k int, v string, seq int")


def test_merge_upsert_last_wins_and_replaces_all_columns(target, changes):
    merged = merge_upsert(target, changes, ["k"], [F.col("seq").desc()])
    assert rows(merged) == [(1, "a"), (2, "new"), (3, None), (4, "d")]
    again = merge_upsert(merged, changes, ["k"], [F.col("seq").desc()])
    assert rows(again) == rows(merged)


def test_write_upsert_keeps_the_old_version(spark, folder, target, changes):
    write_overwrite(target, f"{folder}/v1")
    newest = [F.col("seq").desc()]
    result = write_upsert(spark, f"{folder}/v1", changes, ["k"], newest, f"{folder}/v2")
    assert rows(result) == [(1, "a"), (2, "new"), (3, None), (4, "d")]
    assert spark.read.parquet(f"{folder}/v1").count() == 3
    with pytest.raises(ValueError):
        write_upsert(spark, f"{folder}/v1", changes, ["k"], newest, f"{folder}/v1/")


def test_upsert_partitions_leaves_other_partitions_alone(spark, folder):
    base = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("y", 1, "c")], "p string, k int, v string")
    write_overwrite(base, folder, partition_by=["p"])
    changes = spark.createDataFrame([("x", 2, "B", 1), ("z", 9, "n", 1)], "p string, k int, v string, seq int")
    newest = [F.col("seq").desc()]
    upsert_partitions(spark, folder, changes, ["p", "k"], newest, ["p"])
    found = spark.read.parquet(folder).select("p", "k", "v")
    assert rows(found) == [("x", 1, "a"), ("x", 2, "B"), ("y", 1, "c"), ("z", 9, "n")]
    with pytest.raises(ValueError):
        upsert_partitions(spark, folder, changes, ["k"], newest, ["p"])


def test_upsert_partitions_keeps_null_and_number_like_partitions(spark, folder):
    schema = "p string, k int, v string"
    base = [(None, 1, "a"), (None, 2, "b"), (None, 3, "c"), ("01", 1, "d"), ("1", 1, "e")]
    write_overwrite(spark.createDataFrame(base, schema), folder, partition_by=["p"])
    changes = spark.createDataFrame([(None, 4, "n"), (None, 2, "B"), ("01", 1, "D")], schema)
    upsert_partitions(spark, folder, changes, ["p", "k"], [F.col("v").desc()], ["p"])
    found = spark.read.schema("k int, v string, p string").parquet(folder).select("p", "k", "v")
    expected = [("01", 1, "D"), ("1", 1, "e"), (None, 1, "a"), (None, 2, "B"), (None, 3, "c"), (None, 4, "n")]
    assert rows(found) == sorted(expected, key=repr)


def test_overwrite_append(spark, folder, target):
    write_overwrite(target, f"{folder}/t")
    write_overwrite(target.where("k = 1"), f"{folder}/t")
    write_append(target.where("k = 3"), f"{folder}/t")
    assert rows(spark.read.parquet(f"{folder}/t")) == [(1, "a"), (3, "c")]


def test_sheets_round_trip(spark, folder, target):
    write_sheet(target, f"{folder}/one")
    write_sheet(target.where("k = 1").withColumn("v", F.lit(None).cast("string")), f"{folder}/one", append=True)
    write_sheet(target.select("k"), f"{folder}/two")
    found = read_sheets(spark, {"one": f"{folder}/one", "two": f"{folder}/two"})
    assert found.columns == ["k", "v", "source"]
    assert found.count() == 7
    assert found.where("source = 'two' and v is null").count() == 3
    assert found.where("source = 'one' and v is null").count() == 1


def test_search_path(spark, folder, target):
    write_overwrite(target, f"{folder}/dbo/both.parquet")
    write_overwrite(target.where("k = 1"), f"{folder}/sales/both.parquet")
    write_overwrite(target.where("k = 2"), f"{folder}/sales/only")
    assert read_table(spark, folder, "both", "sales").count() == 3
    assert rows(read_table(spark, folder, "only", "sales")) == [(2, "b")]
    with pytest.raises(FileNotFoundError):
        read_table(spark, folder, "neither", "sales")


def test_other_formats(spark, folder, target):
    target.write.orc(f"{folder}/t.orc")
    target.write.json(f"{folder}/t.json")
    assert rows(read_table(spark, folder, "t", fmt="orc")) == rows(target)
    assert rows(read_table(spark, folder, "t", fmt="json", columns=target.schema)) == rows(target)


def test_views_and_catalog(spark, sf_dir):
    register_views(spark, sf_dir, ["nation", "region"])
    assert spark.sql("select count(*) from nation join region on n_regionkey = r_regionkey").first()[0] == 25
    assert catalog_table(spark, "nation").count() == 25
    with pytest.raises(ValueError):
        catalog_table(spark, "nothing", "here")


def test_union_tagged_needs_tables():
    with pytest.raises(ValueError):
        union_tagged({})


def test_jdbc_options_split_the_read():
    options = jdbc_options("jdbc:x", "t", "s", split_by="id", lower=0, upper=10, partitions=4, user="u")
    assert options["dbtable"] == "s.t" and options["numPartitions"] == "4"
    assert options["partitionColumn"] == "id" and options["user"] == "u"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", split_by="id")


def test_scratch_path_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "a").startswith(f"{shared}/a-")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_upsert_statement(spark, changes):
    assert upsert_statement("s.t", "s.t_new", ["k", "v", "w"], ["k"]) == (
        'INSERT INTO s.t ("k", "v", "w") SELECT "k", "v", "w" FROM s.t_new'
        ' ON CONFLICT ("k") DO UPDATE SET "v" = EXCLUDED."v", "w" = EXCLUDED."w"'
    )
    assert upsert_statement("t", "n", ["k"], ["k"]).endswith('ON CONFLICT ("k") DO NOTHING')
    newest = newest_changes(changes, ["k"], [F.col("seq").desc()])
    assert rows(newest) == [(2, "new", 2), (3, None, 5), (4, "d", 1)]


def test_declared_columns_match_the_files(spark, sf_dir):
    for name in COLUMNS:
        found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        assert found.schema == table(spark, sf_dir, name).schema, name


def test_intake_reads_profiles_and_cleanses(spark, folder):
    data = [("9", "c", 1, "Undefined", 2), (None, "c", None, "BB", 1), ("9", "c", 0, "BB", 0)]
    schema = "agent string, company string, children int, meal string, adults int"
    write_overwrite(spark.createDataFrame(data, schema), f"{folder}/portfolio/hotel.parquet")
    raw, facts, cleansed = intake(spark, folder, "hotel", "portfolio")
    assert raw.count() == 3
    assert facts.where("section = 'nulls' and metric = 'null_count'").count() == 2
    assert rows(cleansed) == [("9", 0, "BB", 1), ("9", 1, "No Meal", 2)]
