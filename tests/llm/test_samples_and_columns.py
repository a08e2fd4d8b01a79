"""Samples stay bounded, columns of other names survive, held-out labels change nothing, letters decide."""

import pytest
from broodline.llm.arrays import held_out
from broodline.llm.labels import distinct_texts, labelled_sample
from broodline.llm.language_id import fit_language_model, identify_language
from broodline.llm.quality import fit_quality, score_quality
from broodline.llm.stages import drop_unknown_language
from broodline.llm.toxicity import fit_toxicity, score_toxicity
from conftest import rows
from pyspark.sql import functions as F


def test_sample_of_null_and_repeated_ids_is_bounded(spark):
    docs = spark.range(5_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    found = distinct_texts(docs, "lang", "text", 50)
    assert found.count() == 50
    one_id = docs.withColumn("doc_id", F.lit(7).cast("long")).union(docs.limit(0))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (None, 1)], "doc_id long, toxic int")
    sample = labelled_sample(one_id, labels, "toxic", 40, F.lit(True))
    assert sample.count() == 80 and {r["label"] for r in sample.collect()} == {1}
    copies = spark.range(3_000).select(F.lit("same").alias("text"), F.lit("en").alias("lang"))
    assert rows(distinct_texts(copies, "lang", "text", 50)) == [("en", "same")]


def test_language_model_of_many_rows_without_an_id(spark):
    words = {"en": "the house and the dog", "de": "das Haus und der Hund"}
    docs = spark.range(4_000).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.concat(F.when(F.col("id") % 2 == 0, words["en"]).otherwise(words["de"]), F.lit(" "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"),
    )
    model = fit_language_model(docs, F.lit(True), rows_per_language=30)
    found = identify_language(docs.limit(200), model)
    assert found.where("lang <> lang_pred").count() == 0


@pytest.mark.parametrize("text", ["½ ² ①", "12 34", "٣٤", "Ⅻ ⅷ", "́̂", "_ _", "!? ☃", ""])
def test_texts_without_a_letter_are_undetermined(spark, text):
    docs = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate([("the dog", "en"), ("der Hund", "de")] * 20)], "doc_id long, text string, lang string")
    model = fit_language_model(docs, F.lit(True))
    odd = spark.createDataFrame([(1, text), (2, text + "日"), (3, text + "é"), (4, text + "ʰ")], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_language(odd, model).collect()}
    assert found[1] == ("und", 0.0)
    assert all(found[k][0] in ("en", "de") for k in (2, 3, 4))


def test_stage_keeps_columns_named_like_its_own(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns(
        {"score": F.col("doc_id") + 100, "lang_pred": F.lit("mine"), "label": F.lit("x"), "place": F.lit("y")}
    )
    kept = drop_unknown_language(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert kept.where("score <> doc_id + 100 or lang_pred <> 'mine' or label <> 'x' or place <> 'y'").count() == 0
    assert kept.count() > 0


def test_held_out_labels_are_never_learnt(spark, sf_dir):
    """Turning round every held-out label, language and source moves no score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    apart = held_out("doc_id", 5, 0)
    turned = labels.select("doc_id", *[F.when(apart, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    for fit, score in ((fit_toxicity, score_toxicity), (fit_quality, score_quality)):
        found = [rows(score(docs, fit(docs, which, ~apart)).select("doc_id", F.round("score", 4))) for which in (labels, turned)]
        assert found[0] == found[1]
    apart = held_out("doc_id", 4, 2)
    turned = docs.withColumn("lang", F.when(apart, F.lit("xx")).otherwise(F.col("lang")))
    found = [
        rows(identify_language(which, fit_language_model(which, ~held_out("doc_id", 4, 2))).select("doc_id", "lang_pred"))
        for which in (docs, turned)
    ]
    assert found[0] == found[1]
