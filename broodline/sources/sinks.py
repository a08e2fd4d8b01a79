"""Writing tables: replace, append, keyed upsert."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.sources.versions import REPLACE_PARTITIONS, partition_key, read_version, versions, write_version


def write_overwrite(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), **options: Any
) -> None:
    """Replace the table at ``path`` with the rows of ``df``."""
    _writer(df, fmt, partition_by, options).mode("overwrite").save(path)


def write_append(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), **options: Any
) -> None:
    """Add the rows of ``df`` behind those at ``path``."""
    _writer(df, fmt, partition_by, options).mode("append").save(path)


def write_sheet(df: DataFrame, path: str, append: bool = False, blank: str = "") -> None:
    """Headed CSV folder for spreadsheet users; NULL cells are written as ``blank``."""
    write = write_append if append else write_overwrite
    write(df, path, "csv", header=True, nullValue=blank, emptyValue=blank)


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 10_000, **options: Any) -> None:
    """Truncate the database table and load ``df`` in batches, keeping its definition."""
    settings = {"url": url, "dbtable": table, "truncate": True, "batchsize": batch_size} | options
    df.write.format("jdbc").options(**settings).mode("overwrite").save()


def upsert_statement(table: str, staging: str, columns: Sequence[str], keys: Sequence[str]) -> str:
    """SQL for the database itself: merge a staging table into ``table`` in one statement.

    Load the newest change per key into ``staging`` with :func:`write_jdbc`, then
    run this on any connection; all columns come from the incoming row.
    """
    names = ", ".join(f'"{c}"' for c in columns)
    others = [c for c in columns if c not in keys]
    update = ", ".join(f'"{c}" = EXCLUDED."{c}"' for c in others)
    action = f"DO UPDATE SET {update}" if others else "DO NOTHING"
    key_list = ", ".join(f'"{k}"' for k in keys)
    return (
        f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}"
        f" ON CONFLICT ({key_list}) {action}"
    )


def newest_changes(
    changes: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]
) -> DataFrame:
    """One row per key: the change that wins."""
    window = Window.partitionBy(*keys).orderBy(*newest_first)
    ranked = changes.withColumn("__rn", F.row_number().over(window))
    return ranked.where(F.col("__rn") == 1).drop("__rn")


def merge_upsert(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]
) -> DataFrame:
    """Target rows with the changes applied: per key the newest change replaces the row.

    A row of ``changes`` replaces **all** columns of the target row with its key,
    or is added. NULLs in a key count as equal. ``newest_first`` decides between several changes of one key.
    """
    keys = list(keys)
    newest = newest_changes(changes, keys, newest_first).select(*target.columns)
    return _matching(target, newest, keys, "left_anti").unionByName(newest)


def write_upsert(
    spark: SparkSession,
    target_path: str,
    changes: DataFrame,
    keys: Sequence[str],
    newest_first: Sequence[Column],
    out_path: str,
    fmt: str = "parquet",
) -> DataFrame:
    """Write the upserted table to ``out_path`` and return it.

    The target stays untouched until the caller switches to the new table, so a
    lost executor or a failed job leaves a readable table behind.
    """
    if out_path.rstrip("/") == target_path.rstrip("/"):
        raise ValueError("write the new version of the table beside the old one")
    target = spark.read.format(fmt).load(target_path)
    write_overwrite(merge_upsert(target, changes, keys, newest_first), out_path, fmt)
    return spark.read.format(fmt).load(out_path)


def upsert_partitions(
    spark: SparkSession,
    target_path: str,
    changes: DataFrame,
    keys: Sequence[str],
    newest_first: Sequence[Column],
    partition_by: Sequence[str],
) -> None:
    """Upsert in place into a partitioned table, rewriting only touched partitions.

    The partition columns must be among the keys, so that no change moves a row
    to another partition. They keep the types they have in ``changes``, so text
    such as ``01`` stays text; NULL partitions are rewritten like others. New files
    are staged, but the commit removes the old files of a touched partition before
    it moves the new ones in: where a driver lost in between must not lose rows, use
    :func:`write_upsert`.
    """
    if not set(partition_by) <= set(keys):
        raise ValueError("partition columns must be part of the key")
    target = _with_partition_types(spark, target_path, changes, partition_by)
    affected = _matching(target, changes.select(*partition_by).distinct(), partition_by, "left_semi")
    merged = merge_upsert(affected, changes, keys, newest_first)
    writer = merged.write.mode("overwrite").partitionBy(*partition_by)
    writer.option("partitionOverwriteMode", "dynamic").parquet(target_path)


def upsert_version(
    spark: SparkSession,
    root: str,
    changes: DataFrame,
    keys: Sequence[str],
    newest_first: Sequence[Column],
    partition_by: Sequence[str],
) -> int:
    """Upsert into a versioned table and return the new version's number.

    Only partitions with a change are read and written; the others keep their
    files. Stopped at any point, the table keeps its old version, which also
    stays readable beside the new one. The partition columns must be among the
    keys. The touched partitions, not their rows, are listed in the driver.
    """
    if not set(partition_by) <= set(keys):
        raise ValueError("partition columns must be part of the key")
    base = versions(root)[-1]
    marks = changes.select(partition_key(partition_by).alias("mark")).distinct()
    touched = {r["mark"] for r in marks.toLocalIterator()}
    target = read_version(spark, root, base, touched)
    merged = merge_upsert(target, changes, keys, newest_first)
    return write_version(merged, root, REPLACE_PARTITIONS, partition_by, base)


def _matching(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join in which NULL keys match each other."""
    marked = {name: f"__other_{name}" for name in keys}
    side = other.select(*keys).withColumnsRenamed(marked)
    same = [F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`")) for a, b in marked.items()]
    return df.join(side, same, how)


def _with_partition_types(
    spark: SparkSession, path: str, changes: DataFrame, partition_by: Sequence[str]
) -> DataFrame:
    """The table at ``path`` with its partition columns read as the types in ``changes``."""
    found = spark.read.parquet(path)
    given = {name: changes.schema[name].dataType for name in partition_by}
    schema = T.StructType(
        [T.StructField(f.name, given.get(f.name, f.dataType)) for f in found.schema]
    )
    return spark.read.schema(schema).parquet(path)


def _writer(df: DataFrame, fmt: str, partition_by: Sequence[str], options: dict[str, Any]):
    writer = df.write.format(fmt).options(**options)
    return writer.partitionBy(*partition_by) if partition_by else writer
