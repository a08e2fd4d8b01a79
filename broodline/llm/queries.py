"""Registered queries of this package: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broodline.llm.arrays import held_out
from broodline.llm.decontaminate import contaminated_pairs
from broodline.llm.fingerprints import fingerprints
from broodline.llm.html_extract import extract_main_text
from broodline.llm.language_id import fit_language_model, identify_language
from broodline.llm.licences import fit_licences, scan_licences
from broodline.llm.near_dup import near_duplicates
from broodline.llm.oracles import PERIODIC_RUNS, PREFIX_TRIE
from broodline.llm.packing import pack
from broodline.llm.periodic import periodic_runs, run_digests, with_made_runs
from broodline.llm.prefix_trie import node_digests, prefix_trie, sequences, with_shared_starts
from broodline.llm.quality import fit_quality, score_quality
from broodline.llm.target_ratio import apply_quality_rules
from broodline.llm.token_files import round_trip
from broodline.llm.toxicity import fit_toxicity, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[key] = build
        return build

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_licences")
def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read(spark, sf_dir, "documents"), fit_licences(spark))


@query("op2_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op3_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))


@query("op5_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item, with the item."""
    return contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op7_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    scored = score_quality(docs, model)
    return scored.select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op8_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


@query("op9_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs, ~held_out("doc_id", 4, 2))
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score"
    )


@query("op11_prefix_trie")
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences(read(spark, sf_dir, "conversations"))
    return node_digests(prefix_trie(with_shared_starts(found)))


@query("op12_target_ratio")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return apply_quality_rules(docs, labels, held_out("doc_id", 5, 0))


@query("op13_periodic_runs")
def periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_made_runs(read(spark, sf_dir, "documents"))))


ORACLES |= {"op11_prefix_trie": PREFIX_TRIE, "op13_periodic_runs": PERIODIC_RUNS}
