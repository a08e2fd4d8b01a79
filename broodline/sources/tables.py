"""Reading tables: directories of files, catalog tables, JDBC, many files as one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the schema looked up before the one the caller names.
FIRST_SCHEMA = "dbo"


def read_table(
    spark: SparkSession,
    root: str,
    name: str,
    schema: str | None = None,
    fmt: str = "parquet",
    columns: T.StructType | str | None = None,
    **options: Any,
) -> DataFrame:
    """Whole table ``name`` below ``root``; the first folder that has it wins.

    With a ``schema`` the search path is ``root/dbo``, then ``root/schema``;
    without one the table lies directly in ``root``. A table is ``name.<fmt>`` or
    a folder ``name``. Given its ``columns`` no job reads files to find them.
    """
    folders = [root] if schema is None else [f"{root}/{FIRST_SCHEMA}", f"{root}/{schema}"]
    missing = None
    for folder in folders:
        for path in (f"{folder}/{name}.{fmt}", f"{folder}/{name}"):
            reader = spark.read.format(fmt).options(**options)
            if columns is not None:
                reader = reader.schema(columns)
            try:
                return reader.load(path)
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                missing = error
    raise FileNotFoundError(f"no table {name!r} in {folders}") from missing


def catalog_table(spark: SparkSession, name: str, schema: str | None = None) -> DataFrame:
    """Catalog table looked up as ``dbo.name``, then ``schema.name``, then ``name``."""
    candidates = [f"{FIRST_SCHEMA}.{name}", f"{schema}.{name}"] if schema else [name]
    for candidate in candidates:
        if spark.catalog.tableExists(candidate):
            return spark.table(candidate)
    raise ValueError(f"no table {name!r} in {candidates}")


def jdbc_options(
    url: str,
    table: str,
    schema: str | None = None,
    split_by: str | None = None,
    lower: Any = None,
    upper: Any = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    **properties: Any,
) -> dict[str, str]:
    """Options for ``spark.read.format("jdbc")``: a parallel, batched table read."""
    options = {
        "url": url,
        "dbtable": f"{schema}.{table}" if schema else table,
        "fetchsize": str(fetch_size),
    }
    if split_by is not None:
        if lower is None or upper is None:
            raise ValueError("split_by needs lower and upper")
        options |= {
            "partitionColumn": split_by,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options | {key: str(value) for key, value in properties.items()}


def read_jdbc(spark: SparkSession, url: str, table: str, **settings: Any) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **settings)).load()


def read_sheets(
    spark: SparkSession, paths: Mapping[str, str], columns: T.StructType | None = None
) -> DataFrame:
    """Headed CSV folders as one table, each row tagged with its sheet title."""
    sheets = {}
    for title, path in paths.items():
        reader = spark.read.option("header", True)
        reader = reader.schema(columns) if columns else reader.option("inferSchema", True)
        sheets[title] = reader.csv(path)
    return union_tagged(sheets)


def union_tagged(tables: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Rows of all tables with the table's name; columns a table lacks are NULL."""
    if not tables:
        raise ValueError("nothing to read")
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    result = tagged[0]
    for df in tagged[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result


def register_views(spark: SparkSession, root: str, names: Sequence[str]) -> None:
    """Temp views of the tables below ``root`` for use in ``spark.sql``."""
    for name in names:
        read_table(spark, root, name).createOrReplaceTempView(name)
