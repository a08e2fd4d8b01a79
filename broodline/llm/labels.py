"""Bounded labelled samples for the classifiers of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broodline.llm.arrays import hash_share


def distinct_texts(rows: DataFrame, label: str, text: str, most: int) -> DataFrame:
    """``label, text``: at most ``most`` different texts of each class, those of least hash.

    Copies of a text count once, so no id, NULL or repeated text can fill a sample.
    Map tasks fold copies and keep no more than ``most`` rows of a class.
    """
    marked = rows.select(F.col(label).alias("label"), F.col(text).alias("text"))
    marked = marked.withColumn("mark", F.xxhash64("text", F.lit("sample")))
    single = marked.groupBy("label", "mark").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("mark"))
    return single.withColumn("place", place).where(F.col("place") <= most).select("label", "text")


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    rows_per_class: int,
    use: Column,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Texts with their 0/1 label: ``text, label``, about ``rows_per_class`` of each class, at most twice that.

    Only label rows for which ``use`` (an expression over ``key``) holds count.
    Conflicting labels of one id resolve to 1; NULL labels and ids are left out.
    The ids of each class are counted first and thinned by a hash of the id, so
    the sample is about the same on any input. It has at most some multiples of
    16 bytes times the bound, which makes the broadcast safe. However many rows an
    id has, and however often a text occurs, each text counts once and the bound holds.
    """
    rows = (
        labels.where(use & F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(key)
        .agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    )
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for value, count in counts.items():
        share = F.when(F.col("label") == value, min(1.0, rows_per_class / count)).otherwise(share)
    chosen = rows.where(hash_share(key, share)).withColumnRenamed(key, "__key")
    texts = docs.select(F.col(key).alias("__doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__key"))
    return distinct_texts(joined, "label", "text", 2 * rows_per_class)
