"""Anchors against the definition, fingerprint texts that round trip, files cut by size, fits of many languages."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from broodline.llm import fingerprints, language_id, token_files
from conftest import rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def brute_anchors(text):
    """Closed syncmers by definition: the least inner s-mer of a k-mer stands at one of its ends."""
    k, s = fingerprints.K, fingerprints.S
    rank = {}
    out = []
    for at in range(len(text) - k + 1):
        inner = [text[at + j : at + j + s] for j in range(k - s + 1)]
        for piece in inner:
            if piece not in rank:
                points = np.frombuffer(piece.encode("utf-32-le"), "<u4").astype(np.uint64)
                value = np.zeros(1, np.uint64)
                for p in points:
                    value = value * np.uint64(0x9E3779B97F4A7C15) + p
                rank[piece] = int(fingerprints.mix(value)[0] >> np.uint64(32))
        ranks = [rank[p] for p in inner]
        if min(ranks) in (ranks[0], ranks[-1]):
            out.append(at)
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefgh éß", "a"])
def test_anchors_are_closed_syncmers(letters):
    draw = random.Random(letters)
    for size in (0, 5, 11, 12, 13, 400):
        text = "".join(draw.choices(letters, k=size))
        _, at = fingerprints.anchors(fingerprints.code_points([text])[0])
        assert at.tolist() == brute_anchors(text)


def test_fingerprint_text_round_trips_and_is_short():
    draw = random.Random(8)
    for size in (0, 3, 12, 500, 70_000):
        text = "".join(draw.choices("abcdefghij klmno", k=size))
        mark = fingerprints.sketch(fingerprints.code_points([text])[0])
        written = fingerprints.to_text(*mark)
        for mine, again in zip(mark, fingerprints.from_text(written), strict=True):
            assert np.array_equal(mine, again)
        assert len(written) < 2 * size + 40
    far = (np.array([5, 9, 1], np.uint32), np.array([2**31, 0, 127], np.int64))
    back = fingerprints.from_text(fingerprints.to_text(*far))
    assert back[0].tolist() == [1, 5, 9] and back[1].tolist() == [127, 2**31, 0]


def test_ranges_of_ids_do_not_share_tasks(spark):
    docs = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    dealt = fingerprints.dealt_in_order(docs, "doc_id", "text")
    per_task = dealt.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["parts"] == 1 for r in per_task)
    sizes = sorted(r["n"] for r in per_task)
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_token_files_of_one_id_and_of_many_ids_per_file(spark, tmp_path, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [(None, f"no id {k}") for k in range(40)] + [(7, f"same id {k}") for k in range(40)] + [(k, f"own id {k} " * 9) for k in range(100, 140)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(token_files, "IDS_PER_FILE", 50)
    folder = str(tmp_path / "files")
    manifest = token_files.write_token_files(df, folder, path, 2)
    files = manifest.collect()
    assert len(files) > 20 and max(r["n_docs"] for r in files) < 25
    assert sum(r["n_docs"] for r in files) == 120 and len({r["order"] for r in files}) == len(files)
    found = token_files.read_token_files(spark, folder, manifest).collect()
    crc = lambda text: zlib.crc32(np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted(((r["doc_id"], r["ids_crc32"]) for r in found), key=repr) == sorted(((d, crc(t)) for d, t in texts), key=repr)
    start = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_many_languages_fit_in_the_executors(spark):
    """Sixty made languages, each with letters of its own; the driver sees centres and planes."""
    draw = random.Random(3)
    data = []
    for lang in range(60):
        letters = "".join(chr(0x4E00 + draw.randrange(400)) for _ in range(12))
        data += [(lang * 100 + k, "".join(draw.choices(letters, k=80)), f"l{lang:02d}") for k in range(30)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(8)
    model = language_id.fit_language_model(docs, F.col("doc_id") % 3 > 0, rows_per_language=20)
    assert sum(map(len, model.families.values())) == 60 and len(model.families) == 8
    assert len(model.between) == 28
    assert sum(map(len, model.within.values())) == sum(len(m) * (len(m) - 1) // 2 for m in model.families.values())
    found = language_id.identify_language(docs.where("doc_id % 3 = 0"), model)
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()
    assert rows(found.select("doc_id", "lang_pred")) == rows(
        language_id.identify_language(docs.where("doc_id % 3 = 0").repartition(3), model).select("doc_id", "lang_pred")
    )
