"""A training-data pipeline over ``documents``: five stages, each written and read again.

``STAGES`` names the stages. Each takes (spark, docs, sf_dir) and returns what it
keeps; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from broodline.llm.stages import (
    drop_contaminated,
    drop_near_copies,
    drop_poor_quality,
    drop_unknown_language,
    pack_sequences,
)
from broodline.sources.scratch import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", drop_unknown_language),
    ("quality", drop_poor_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained models and hashing take part, which SQL cannot express; tests check each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; every result goes through Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
