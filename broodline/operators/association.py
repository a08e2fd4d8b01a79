"""Correlation of category indicators with an outcome per calendar bucket.

For a 0/1 indicator Pearson's r needs only counts and means,
``r = (mean of members - mean of all) / sd * sqrt(p / (1 - p))``, so the indicator
matrix is never built. Rows are folded on the map side to cells, one per bucket
and combination of category values, and to one total per bucket; features are
derived from the cells. A bucket or category holding most rows costs a reducer no
more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broodline.functions.calendar import bucket_headings, bucket_label
from broodline.functions.numeric import nan_as_null
from broodline.functions.text import Recodes, recode

BUCKET = ["year", "month", "week_of_month"]


def indicator_correlation(
    rows: DataFrame,
    cell: Sequence[str],
    features: Column,
    outcome: str,
    bucket: Sequence[str] = BUCKET,
    digits: int = 3,
) -> DataFrame:
    """``(bucket.., feature, n, n_feature, r)``; r is NULL where it is undefined.

    ``features`` is an array naming the indicators that are 1, computed from the
    ``cell`` columns. Rows without an outcome (NULL or NaN) take no part. r is undefined for a
    bucket of one row, a constant outcome, or a feature all rows of the bucket
    have.
    """
    keys, cell = list(bucket), list(cell)
    outcomes = rows.select(*keys, *cell, nan_as_null(F.col(outcome).cast("double")).alias("y"))
    folded = (
        outcomes.where(F.col("y").isNotNull())
        .groupingSets([[*keys, *cell], keys], *keys, *cell)
        .agg(
            F.grouping(cell[0]).alias("is_total"),
            F.count("y").alias("cell_n"),
            F.avg("y").alias("cell_mean"),
            F.var_pop("y").alias("cell_variance"),
        )
    )
    total_only = F.array(F.lit(None).cast("string"))
    named = F.when(F.col("is_total") == 1, total_only).otherwise(F.array_compact(features))
    weighted = F.sum(F.col("cell_n") * F.col("cell_mean"))
    per_feature = (
        folded.withColumn("feature", F.explode(named))
        .groupBy(*keys, "feature")
        .agg(
            F.sum("cell_n").alias("n_feature"),
            (weighted / F.sum("cell_n")).alias("mean_feature"),
            F.max("cell_variance").alias("variance"),
        )
    )
    in_bucket = Window.partitionBy(*keys)

    def total(name: str) -> Column:
        return F.max(F.when(F.col("feature").isNull(), F.col(name))).over(in_bucket)

    share = F.col("n_feature") / F.col("n")
    defined = (F.col("n") > F.col("n_feature")) & (F.col("spread") > 0)
    r = (F.col("mean_feature") - F.col("mean_all")) * F.sqrt(
        F.try_divide(share, (1 - share) * F.col("spread"))
    )
    # Adding 0.0 turns a rounded -0.0 into 0.0.
    return (
        per_feature.withColumns(
            {"n": total("n_feature"), "mean_all": total("mean_feature"), "spread": total("variance")}
        )
        .where(F.col("feature").isNotNull())
        .select(*keys, "feature", "n", "n_feature", F.when(defined, F.round(r, digits) + 0.0).alias("r"))
    )


def correlation_report(
    correlations: DataFrame,
    years: Sequence[int],
    max_week: int = 6,
    skip_buckets: int = 0,
    descending: bool = True,
    label_map: Recodes = (),
    features: DataFrame | None = None,
) -> DataFrame:
    """One row per feature, one column per calendar bucket of the given years.

    The headings follow from the parameters, so the pivot needs no job to find
    its values. Every feature of ``correlations`` keeps a row, and so does every
    value of ``features`` (a one-column table) if given, say of features whose
    outcomes are all missing; buckets without a value are NULL. ``label_map`` renames features for the reader.
    """
    headings = bucket_headings(list(years), max_week, skip_buckets)
    labelled = correlations.select(
        "feature", "r", bucket_label("month", "year", "week_of_month").alias("heading")
    )
    wide = labelled.groupBy("feature").pivot("heading", headings).agg(F.first("r", ignorenulls=True))
    if features is not None:
        listed = features.toDF("feature").where("feature IS NOT NULL").distinct()
        wide = listed.join(wide, "feature", "left")
    order = F.col("feature").desc() if descending else F.col("feature").asc()
    return wide.orderBy(order).withColumn("feature", recode("feature", label_map))
