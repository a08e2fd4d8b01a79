"""The stages of the corpus pipeline, each an operator of this package with a decision."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broodline.llm.arrays import held_out
from broodline.llm.decontaminate import with_matches
from broodline.llm.graph import settled
from broodline.llm.language_id import UNDETERMINED, fit_language_model, identify_language
from broodline.llm.near_dup import near_duplicates
from broodline.llm.packing import pack
from broodline.llm.quality import fit_quality, score_quality

#: A document must be this likely of good quality to stay.
QUALITY = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that training knows; texts without a letter go."""
    model = fit_language_model(docs, ~held_out("doc_id", 4, 2))
    found = identify_language(docs, model, name="__language", score="__certainty")
    return found.where(F.col("__language") != UNDETERMINED).select(*docs.columns)


def drop_poor_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good with a probability of at least ``QUALITY``."""
    labels = table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, ~held_out("doc_id", 5, 0))
    scored = score_quality(docs, model, name="__quality")
    return scored.where(F.col("__quality") >= QUALITY).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, one with the least id.

    Five-word shingles and a similarity of 0.8. Rows are judged and dropped by a
    number of their own, written once, so an id may occur several times, with one
    text or many. Documents without words, and rows without an id, stay.
    """
    rows = settled(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    named = rows.where(F.col("doc_id").isNotNull())
    found = near_duplicates(named, words=5, percent=80, key="__row").select("__row", "component_id")
    ids = named.select("__row", "doc_id")
    first = found.join(ids, "__row").groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("first"))
    gone = ids.join(first.select("first.__row"), "__row", "left_anti").select("__row")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = with_matches(docs, table(spark, sf_dir, "benchmark"), name="__matches")
    return found.where(F.size("__matches") == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
