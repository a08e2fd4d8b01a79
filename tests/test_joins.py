import random

import pytest
from broodline.operators import fuzzy
from broodline.operators.fuzzy import fuzzy_topk_join, plain_text, similar_pairs, sorted_words
from broodline.operators.joins import join_normalized, join_renamed, require_unique, skew_joined
from conftest import rows
from pyspark.sql import functions as F


def test_join_renamed_keeps_left_keys_and_refuses_clashes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (None, 20)], "kk int, w int")
    assert join_renamed(a, b, {"k": "kk"}).columns == ["k", "v", "w"]
    assert rows(join_renamed(a, b, {"k": "kk"}, "left")) == [
        (1, "x", 10),
        (2, "y", None),
        (None, "z", None),
    ]
    with pytest.raises(ValueError):
        join_renamed(a, b.withColumn("v", F.lit(1)), {"k": "kk"})


def test_join_normalized(spark):
    a = spark.createDataFrame([(" abc ",), ("ABC",), ("Abc",), (None,), ("x",)], "name string")
    b = spark.createDataFrame([("abc ", 1), (None, 2)], "other string, n int")
    found = join_normalized(a, b, "name", "other").select("name", "n")
    assert rows(found) == [(" abc ", 1), ("ABC", 1), ("Abc", 1), ("x", None), (None, None)]


def test_require_unique(spark):
    good = spark.createDataFrame([(1, "a", None), (2, None, "b")], "k int, v string, w string")
    assert rows(require_unique(good, ["k"])) == [(1, "a", None), (2, None, "b")]
    bad = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key"):
        require_unique(bad, ["k"]).collect()


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_skew_joined_equals_plain_join(spark, block):
    rng = random.Random(3)
    left = [(i, "hot" if i % 3 else str(rng.randrange(9))) for i in range(120)]
    right = [(i, "hot" if i % 3 else str(rng.randrange(9))) for i in range(90)]
    a = spark.createDataFrame(left, "i int, k string")
    b = spark.createDataFrame(right, "j int, k string")
    tiled = skew_joined(a, b, ["k"], block).select("i", "j", "k")
    assert rows(tiled) == rows(a.join(b, "k").select("i", "j", "k"))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def score(a, b):
    longer = max(len(a), len(b))
    return 100 * (longer - levenshtein(a, b)) / longer


def noisy_names(seed, n, alphabet, lengths):
    """Random names with near copies a few edits away."""
    rng = random.Random(seed)
    names = set()
    while len(names) < n:
        name = "".join(rng.choice(alphabet) for _ in range(rng.choice(lengths)))
        names.add(name)
        for _ in range(3):
            at = rng.randrange(len(name))
            edit = rng.choice(["", rng.choice(alphabet), rng.choice(alphabet) + name[at]])
            name = name[:at] + edit + name[at + 1 :] or "a"
            names.add(name)
    return sorted(names)


@pytest.mark.parametrize(
    "threshold, alphabet, lengths",
    [
        (100, "ab", [1, 2, 3]),
        (90, "abc", [5, 12, 18, 25, 40]),
        (87.5, "ab", [8, 16, 31]),
        (80, "abcd", [4, 9, 15, 24]),
        (60, "ab", [1, 2, 3, 5, 8]),
        (40, "abc", [1, 3, 6]),
        (5, "ab", [1, 4]),
    ],
)
def test_similar_pairs_equal_all_pairs(spark, threshold, alphabet, lengths):
    left = noisy_names(1, 60, alphabet, lengths)
    right = noisy_names(2, 60, alphabet, lengths) + left[::4]
    right = sorted(set(right))
    a = spark.createDataFrame([(x, x) for x in left], "a string, ta string")
    b = spark.createDataFrame([(x, x, 1) for x in right], "b string, tb string, copies int")
    found = similar_pairs(a, b, threshold, block=5).select("a", "b", F.round("score", 6))
    expected = [
        (x, y, round(score(x, y), 6)) for x in left for y in right if score(x, y) >= threshold
    ]
    assert rows(found) == sorted(expected, key=repr)
    assert expected


def test_common_words_lose_no_pair(spark):
    """Every name holds the same long words; only rare pieces tell names apart."""
    words = ["north ", " farm cluster ", " unit"]

    def phrase(name):
        return words[0] + name[: len(name) // 2] + words[1] + name[len(name) // 2 :] + words[2]

    left = [phrase(n) for n in noisy_names(4, 120, "abcdef", [14, 20])]
    right = [phrase(n) for n in noisy_names(5, 80, "abcdef", [14, 20])] + left[::5]
    right = sorted(set(right))
    a = spark.createDataFrame([(x, x) for x in left], "a string, ta string")
    b = spark.createDataFrame([(x, x, 1) for x in right], "b string, tb string, copies int")
    for threshold in (85, 93):
        found = similar_pairs(a, b, threshold, block=10).select("a", "b")
        expected = [(x, y) for x in left for y in right if score(x, y) >= threshold]
        assert rows(found) == sorted(expected, key=repr)
        assert len(expected) > len(left[::5])


def test_fuzzy_topk_limit_copies_and_no_match(spark):
    left = spark.createDataFrame(
        [(1, "North Farm"), (2, "north-farm!"), (3, ""), (4, None), (5, "zzz"), (6, "North Farm")],
        "id int, name string",
    )
    right = spark.createDataFrame(
        [("North Farm",), ("North Farm",), ("NORTH FARN",), ("South Farm",), (None,), ("",)],
        "other string",
    )
    once = fuzzy_topk_join(left, right, "name", "other", 80, 2, dedupe_right=True)
    both = "North Farm, NORTH FARN"
    assert [r[2] for r in rows(once)] == [both, both, "", "", "", both]
    copies = fuzzy_topk_join(left, right, "name", "other", 80, 2)
    twice = "North Farm, North Farm"
    assert [r[2] for r in rows(copies)] == [twice, twice, "", "", "", twice]
    three = fuzzy_topk_join(left, right, "name", "other", 80, 3, out="m3")
    assert rows(three)[0] == (1, "North Farm", "North Farm, North Farm, NORTH FARN")


def test_keys_per_name_grow_with_its_length_only(spark):
    """Long names make pieces, never the square of their length in deletion variants."""
    lengths = [20, 40, 100, 300, 1000]
    text = "".join(chr(97 + i * i % 23) for i in range(1000))
    names = spark.createDataFrame([(text[:n], text[:n], n) for n in lengths], "a string, ta string, la int")
    for threshold in (90, 99):
        reaches = F.expr(fuzzy.short(fuzzy.shortest_partner("la", threshold), threshold))
        variants = fuzzy._variant_keys(names.where(reaches), "ta", "la", threshold)
        assert {r["la"] for r in variants.select("la").distinct().collect()} <= {20}
        pieces = fuzzy._probe_pieces(names, threshold).groupBy("la").count().collect()
        assert len(pieces) >= 3
        assert all(n <= 4 * la for la, n in pieces)


def test_sorted_words_forgive_order(spark):
    df = spark.createDataFrame([("river farm unit seven",)], "n string")
    other = spark.createDataFrame([("Unit seven, river farm",)], "m string")
    found = fuzzy_topk_join(df, other, "n", "m", 90, processor=sorted_words)
    assert found.first()["matches"] == "Unit seven, river farm"
    assert fuzzy_topk_join(df, other, "n", "m", 90).first()["matches"] == ""


def test_threshold_is_checked(spark):
    df = spark.createDataFrame([("a",)], "n string")
    with pytest.raises(ValueError):
        fuzzy_topk_join(df, df, "n", "n", 0)


def test_plain_text(spark):
    df = spark.createDataFrame([("  A-b_c, É! ",)], "n string")
    assert df.select(plain_text(F.col("n"))).first()[0] == "a b_c  é"
