"""Versioned tables: whole versions only, old ones readable, untouched partitions keep their files."""

import datetime as dt
import json
import os

import pyarrow as pa
import pytest
from broodline.sources import versions as v
from broodline.sources.sinks import upsert_version
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

COLUMNS = "part string, k long, x double, day date"


def table(spark, data):
    return spark.createDataFrame(data, COLUMNS)


def all_files(root):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names if not n.endswith(".crc"))


DATA = [("a", 1, 1.0, dt.date(2024, 1, 1)), ("a", 2, None, None), ("b", 3, 3.0, None), (None, 4, 4.0, None), ("", 5, 5.0, None)]


def test_versions_replace_append_and_stay_readable(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        v.read_version(spark, root)
    first = table(spark, DATA)
    assert v.write_version(first, root) == 1
    assert v.write_version(first.where("k > 3"), root, v.APPEND) == 2
    assert v.write_version(first.where("k = 1"), root, v.REPLACE_ALL) == 3
    assert v.read_version(spark, root).schema == first.schema
    assert [len(rows(v.read_version(spark, root, n))) for n in (1, 2, 3)] == [5, 7, 1]
    assert rows(v.read_version(spark, root, 1)) == sorted(DATA, key=repr)
    assert v.write_version(first.limit(0), root) == 4 and rows(v.read_version(spark, root)) == []
    with pytest.raises(FileNotFoundError):
        v.read_version(spark, root, 9)
    with pytest.raises(ValueError, match="other columns"):
        v.write_version(first.drop("x"), root, v.APPEND)


@pytest.mark.parametrize("change", [v.APPEND, v.REPLACE_ALL, v.REPLACE_PARTITIONS])
def test_failed_task_leaves_the_table_as_it_was(spark, tmp_path, change):
    root = str(tmp_path / "t")
    v.write_version(table(spark, DATA), root, partition_by=["part"])
    before = all_files(root)
    broken = spark.range(0, 1000, 1, 8).select(
        F.lit("a").alias("part"), F.col("id").alias("k"),
        F.when(F.col("id") == 990, F.raise_error(F.lit("lost"))).otherwise(1.0).cast("double").alias("x"),
        F.lit(None).cast("date").alias("day"),
    )
    with pytest.raises(PySparkException, match="lost"):
        v.write_version(broken, root, change, ["part"])
    assert v.versions(root) == [1] and all_files(root) == before
    assert rows(v.read_version(spark, root)) == sorted(DATA, key=repr)


def test_stops_between_the_steps(spark, tmp_path):
    """Files without a manifest, and a manifest that was never renamed, are not seen."""
    root = str(tmp_path / "t")
    df = table(spark, DATA)
    v.write_version(df, root)
    writer = v.VersionWriter(root, df.schema, v.REPLACE_ALL, 1, "data/next")
    batch = pa.RecordBatch.from_pylist([{"part": "z", "k": 9, "x": 0.0, "day": None}] * 3)
    message = writer.write(iter([batch, batch]))
    assert sum(f["rows"] for f in message.files) == 6
    assert len(rows(v.read_version(spark, root))) == 5  # driver lost before the commit
    (tmp_path / "t" / "versions" / "abc.draft").write_text('{"version": 2')
    assert v.versions(root) == [1]  # driver lost before the rename
    writer.commit([message, None])  # the step itself
    assert len(v.manifest(root).files) == 1 and v.versions(root) == [1, 2]
    assert len(rows(v.read_version(spark, root, 1))) == 5
    late = v.VersionWriter(root, df.schema, v.APPEND, 1, "data/late")
    message = late.write(iter([batch]))
    with pytest.raises(v.VersionConflict):
        late.commit([message])
    late.abort([message])
    assert not (tmp_path / "t" / "data" / "late").exists() and v.versions(root) == [1, 2]


def test_upsert_touches_changed_partitions_only(spark, tmp_path):
    root = str(tmp_path / "t")
    v.write_version(table(spark, DATA), root, partition_by=["part"])
    changes = table(spark, [("a", 2, 7.0, None), ("a", 2, 8.0, None), (None, 4, 9.0, None), ("new", 1, 1.0, None)])
    assert upsert_version(spark, root, changes, ["part", "k"], [F.col("x").desc()], ["part"]) == 2
    wanted = [DATA[0], ("a", 2, 8.0, None), DATA[2], (None, 4, 9.0, None), DATA[4], ("new", 1, 1.0, None)]
    assert rows(v.read_version(spark, root)) == sorted(wanted, key=repr)
    assert rows(v.read_version(spark, root, 1)) == sorted(DATA, key=repr)
    paths = [{f["partition"]: f["path"] for f in v.manifest(root, n).files} for n in (1, 2)]
    kept = {p for p, path in paths[0].items() if paths[1].get(p) == path}
    assert {json.loads(p)[0] for p in kept} == {"b", ""}
    assert rows(v.read_version(spark, root, partitions={'["b"]'})) == [DATA[2]]
    with pytest.raises(ValueError, match="part of the key"):
        upsert_version(spark, root, changes, ["k"], [F.col("x").desc()], ["part"])
    none = upsert_version(spark, root, changes.limit(0), ["part", "k"], [F.col("x").desc()], ["part"])
    assert none == 3 and len(rows(v.read_version(spark, root))) == 6


def test_hot_partition_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(0, 60_000, 1, 4).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 4)).alias("part"),
            F.xxhash64("id").alias("k"),
        )
        root = str(tmp_path / "t")
        v.write_version(df, root, partition_by=["part"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = v.manifest(root).files
    hot = [f["rows"] for f in files if f["partition"] == '["hot"]']
    assert sum(hot) == 20_000 and len(hot) > 1
    assert v.read_version(spark, root).count() == 60_000
