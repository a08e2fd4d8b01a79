"""Tiling against a naive greedy one, short and space-less items, repetition, clashing columns."""

import random
import time
import tracemalloc

import pytest
from broodline.llm import decontaminate
from conftest import rows
from pyspark.sql import functions as F


def naive_tiles(item, text, least):
    taken_i, taken_t = [False] * len(item), [x == -1 for x in text]
    covered = count = 0
    while True:
        best = None
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while (
                    i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n]
                    and not taken_i[i + n] and not taken_t[t + n]
                ):
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, t)
        if best is None:
            return covered, count
        n, i, t = best
        taken_i[i : i + n] = [True] * n
        taken_t[t : t + n] = [True] * n
        covered, count = covered + n, count + 1


@pytest.mark.parametrize("seed", range(4))
def test_tiles_equal_naive_greedy_tiling(seed):
    draw = random.Random(seed)
    for _ in range(200):
        letters = draw.choice([1, 2, 3, 4, 8])
        item = [draw.randrange(letters) for _ in range(draw.randrange(40))]
        text = [draw.randrange(letters) if draw.random() > 0.05 else -1 for _ in range(draw.randrange(60))]
        if draw.random() < 0.3:
            text = text[:10] + item[5:] + text[10:20] + item[:5]
        least = draw.choice([1, 2, 3, 5])
        assert decontaminate.tile(item, text, least) == naive_tiles(item, text, least)


def test_repetition_costs_no_product():
    index = decontaminate.build_index([1], ["a " * 1000], 5)
    for text in ("a " * 40_000, " ".join(f"{'a ' * 7} x{k}" for k in range(5000))):
        hashes, _ = decontaminate.word_hashes(decontaminate.pa.array([text]))
        rolled = decontaminate.seeds(hashes, 5)
        at = decontaminate.np.flatnonzero(decontaminate.np.isin(rolled, index.seeds[5].values))
        tracemalloc.start()
        start = time.process_time()
        found = decontaminate.matches(index, 5, hashes, rolled, at, 5, 0.8)
        assert time.process_time() - start < 1 and tracemalloc.get_traced_memory()[1] < 200e6
        tracemalloc.stop()
        assert found[0]["coverage"] == 1.0


def test_short_and_spaceless_items(spark):
    items = spark.createDataFrame(
        [(1, "what is two plus"), (2, "法国的首都是哪座城市"), (3, "yes"), (4, "ใครเป็นคนแรก"), (5, ""), (6, "!!"), (7, None), (8, "Ça va")],
        "item_id long, text string",
    )
    texts = [
        (1, "He asked: What is two plus three?"), (2, "what is two, then plus"), (3, "问题：法国的首都是哪座城市？答案"), (4, "法国的首都在哪座山上"),
        (5, "yes"), (6, "yes it is"), (7, " YES! "), (8, "คำถาม ใครเป็นคนแรก ครับ"), (9, "ÇA VA?"), (10, ""), (11, None), (12, "yes yes"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = decontaminate.contaminated_pairs(docs, items)
    assert rows(found.select("doc_id", "item_id")) == sorted([(1, 1), (3, 2), (5, 3), (7, 3), (8, 4), (9, 8)], key=repr)


def test_rows_and_clashing_columns_stay(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame(
        [(1, item, "mine", 5), (1, item, "mine", 5), (None, None, None, 5), (2, "w1 w2", "mine", 5)],
        "doc_id long, text string, matches string, item_id int",
    )
    items = spark.createDataFrame([(9, item, "x"), (9, item, "x")], "item_id long, text string, doc_id string")
    found = decontaminate.with_matches(docs, items, name="__found")
    assert found.columns == [*docs.columns, "__found"]
    assert rows(found.select("doc_id", "matches", "item_id", F.size("__found"))) == sorted(
        [(1, "mine", 5, 2), (1, "mine", 5, 2), (None, None, 5, 0), (2, "mine", 5, 0)], key=repr
    )
    replaced = decontaminate.with_matches(docs, items)
    assert sorted(replaced.columns) == sorted(docs.columns)
    pairs = rows(decontaminate.contaminated_pairs(docs, items))
    assert pairs == [(1, 9, 1.0, 1)] * 4
