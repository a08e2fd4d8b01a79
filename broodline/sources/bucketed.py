"""Tables stored by key, so that windows, groupings and joins on that key need no exchange."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broodline.sources.scratch import scratch_path


def write_bucketed(
    df: DataFrame,
    keys: Sequence[str],
    buckets: int,
    order: Sequence[str] = (),
    name: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """Write ``df`` once as a catalog table in ``buckets`` by ``keys``, sorted by keys and ``order``, and return it.

    Whatever then partitions by the keys, or by more columns beginning with them,
    reads its bucket and shuffles nothing; two tables with the same keys and
    buckets join bucket by bucket. All rows of a key lie in one bucket, so the keys
    must be fine enough (a cycle, an order), not a brand that holds a third of the
    rows. Without a ``path`` the files go to the shared scratch folder.
    """
    keys = list(keys)
    spark: SparkSession = df.sparkSession
    table = name or f"bucketed_{uuid.uuid4().hex}"
    by_bucket = df.repartition(buckets, *[F.col(k) for k in keys])  # one file for each bucket
    writer = by_bucket.write.format("parquet").option("path", path or scratch_path(spark, "bucketed"))
    writer.bucketBy(buckets, *keys).sortBy(*keys, *order).mode("overwrite").saveAsTable(table)
    return spark.table(table)
