"""The pipeline: stages keep columns, decisions take effect, and the result equals its stages in order."""

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from broodline.llm.stages import drop_near_copies


def test_registered():
    names = set(queries())
    for n in range(1, 14):
        assert any(k.startswith(f"op{n}_") for k in names)
    assert "pipeline" in names and set(oracle_sql()) <= names


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r[0] for r in docs.select("doc_id").collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        after = {r[0] for r in docs.select("doc_id").collect()}
        assert after <= before
        if number < 4:
            assert docs.columns == columns
            seen.append(len(before) - len(after))
    assert after == before  # packing keeps every document
    assert seen[1] > 0 and seen[2] > 0  # poor documents and copies go
    assert len(after) > 0.6 * 200


def test_near_copies_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{name}{k}" for k in range(30)) for name in "abc")
    rows = [(5, a), (5, b), (1, a), (7, b), (9, c), (9, c), (None, a), (None, a), (3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((tuple(r) for r in drop_near_copies(spark, docs, "").collect()), key=repr)
    wanted = [(1, a), (5, b), (9, c), (None, a), (None, a), (3, ""), (3, ""), (4, None)]
    assert found == sorted(wanted, key=repr)
    same = spark.createDataFrame([(5, a), (5, b), (5, a), (5, c)], "doc_id long, text string")
    assert sorted(r["text"] for r in drop_near_copies(spark, same, "").collect()) == [a, b, c]
