"""The sieve parts template texts, keeps near copies together, and recall near the threshold is high."""

import random

import numpy as np
import pytest
from broodline.llm import near_dup
from broodline.llm.graph import connected_components
from pyspark.sql import functions as F


def template_texts(count, own, seed):
    """Texts of 200 words of which ``own`` are their own: all pairs share the others."""
    draw = random.Random(seed)
    base = [f"t{k}" for k in range(200 - own)]
    return [" ".join(base + [f"x{draw.randrange(10**9)}" for _ in range(own)]) for _ in range(count)]


def test_agreements_needed():
    for threshold, minhashes in ((0.85, 96), (0.8, 96)):
        needed = near_dup.agreements_needed(threshold, minhashes)
        draws = np.random.default_rng(1).binomial(minhashes, threshold, 400_000)
        assert (draws < needed).mean() < 2 * near_dup.SIEVED
        assert (np.random.default_rng(2).binomial(minhashes, 0.4, 400_000) >= needed).mean() < 2e-5


@pytest.mark.parametrize("sides", [False, True])
def test_agreeing_rows_equal_brute_force(sides):
    draw = np.random.default_rng(3)
    heads = draw.integers(0, 3, (60, 12)).astype(np.uint8)
    heads[30:40] = heads[5]
    side = draw.random(60) < 0.5 if sides else np.zeros(60, bool)
    found = near_dup.agreeing(heads, side, 8)
    names = list(range(60))

    def root(k):
        while names[k] != k:
            k = names[k]
        return k

    pairs = [
        (i, j) for i in range(60) for j in range(i) if (heads[i] == heads[j]).sum() >= 8 and (not sides or side[i] != side[j])
    ]
    assert set(map(frozenset, found)) <= set(map(frozenset, pairs))
    for i, j in pairs:
        names[root(i)] = root(j)
    wanted = {frozenset(k for k in range(60) if root(k) == r) for r in set(map(root, range(60)))}
    names = list(range(60))
    for i, j in found:
        assert root(i) != root(j)  # a forest
        names[root(i)] = root(j)
    assert {frozenset(k for k in range(60) if root(k) == r) for r in set(map(root, range(60)))} == wanted


def test_texts_of_one_template_fall_apart(spark):
    texts = template_texts(4000, 85, 5)  # similarity about 0.4
    near = template_texts(1, 85, 9)[0]
    copies = [near.replace("t3 ", f"y{k} ") for k in range(90)]
    df = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string").repartition(8)
    signed = near_dup.signatures(df, 3, 0.85, "doc_id", "text")
    reps = signed.select(F.col("doc").alias("rep"), "digest", "a", "b", "heads")
    whole = connected_components(near_dup.candidate_edges(reps))
    before = whole.groupBy("component").count().agg(F.max("count")).first()[0]
    after = near_dup.sieved(whole, reps, 0.85).groupBy("component").count().collect()
    assert before > 1000  # without the sieve the template is one group
    assert sorted((r["count"] for r in after), reverse=True)[0] <= 95
    found = near_dup.near_duplicates(df, words=3, percent=85)
    sizes = sorted((r["count"] for r in found.groupBy("component_id").count().collect()), reverse=True)
    assert sizes[:2] == [90, 1]


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_recall_of_pairs_just_over_the_threshold(spark, words, percent):
    """Pairs of texts whose likeness lies within five points over the threshold."""
    draw, texts, wanted = random.Random(4), [], 0
    while wanted < 1500:
        base = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice([60, 120, 300]))]
        other = list(base)
        for at in draw.sample(range(len(base)), draw.randrange(1, 12)):
            other[at] = f"v{draw.randrange(10**6)}"
        a, b = ({tuple(x[k : k + words]) for k in range(len(x) - words + 1)} for x in (base, other))
        likeness = 100 * len(a & b) / len(a | b)
        if percent <= likeness <= percent + 5:
            texts += [(2 * wanted, " ".join(base)), (2 * wanted + 1, " ".join(other))]
            wanted += 1
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    found = near_dup.near_duplicates(df, words=words, percent=percent)
    linked = found.where("component_id <> doc_id").count()
    assert linked >= 0.99 * wanted
    assert linked <= wanted
