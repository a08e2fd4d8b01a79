"""Prefix trie, quality rules and periodic runs against brute force, SQL and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import pyarrow as pa
import pytest
from broodline.llm import target_ratio
from broodline.llm.arrays import held_out
from broodline.llm.periodic import find_runs, periodic_runs, run_digests, runs_of_texts, with_made_runs
from broodline.llm.prefix_trie import ends_digests, node_digests, prefix_trie, sequences, with_shared_starts
from broodline.llm.queries import ORACLES, QUERIES
from conftest import rows
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, key):
    duck = compare.connect(sf_dir)
    df = QUERIES[key](spark, sf_dir)
    assert compare.spark_rows(df) == compare.oracle_rows(duck, ORACLES[key])
    assert compare.type_mismatches(df, duck, ORACLES[key]) == []


# --- conversation prefix trie ------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items() if c is not None}
    whole = {}
    for conv, seq in own.items():
        taken = zlib.crc32(str(conv).encode()) % 4
        whole[conv] = own.get(conv - conv % 20, [])[:taken] + seq[taken:]
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv, seq in whole.items():
        ends[tuple(seq)].append(conv)
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(conv)
            if d:
                below[tuple(seq[: d - 1])].add(tuple(seq[:d]))
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        words = len(WORD.findall(p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in below[p])
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        above = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), above, len(members[p]), len(below[p]), leaves[p], saved[p], digest))
    return sorted(out, key=repr)


def trie_rows(spark, turns, turns_per_range=1_000_000):
    found = sequences(spark.createDataFrame(turns, TURNS).repartition(3))
    return rows(node_digests(prefix_trie(with_shared_starts(found), turns_per_range)))


@pytest.mark.parametrize("kind", ["bushy", "hot", "deep"])
def test_trie_equals_brute_force(spark, kind):
    draw = random.Random(kind)
    texts = ["x", "x y", "", None, "z  z\tz"]
    turns = [
        (c, t, draw.choice("ua"), draw.choice(texts))
        for c in range(draw.choice([50, 300]))
        for t in range(draw.choice([1, 2, 3, 5]))
    ]
    if kind == "hot":  # a third of all rows is one sequence, over many ranges
        turns += [(1000 + k, t, "u", f"same {t}") for k in range(300) for t in range(5)]
    if kind == "deep":
        turns += [(c, t, "u", f"long {t}") for c in (2000, 2001, 2020) for t in range(400)]
    assert trie_rows(spark, turns, 20 if kind == "hot" else 300) == brute_trie(turns)


def test_trie_of_odd_turns(spark):
    turns = [
        (1, None, None, None), (1, 2, "a", "b  c"), (1, 2, "a", "b  c"),  # NULLs, a repeated row
        (2, 5, "", ""), (None, 1, "a", "lost"), (-3, 1, "a", "word " * 50_000), (20, 1, "a", "x"), (21, 7, "a", "x"),
        (45, 1, "a", "x"), (45, 0, "role:", "x"), (45, 1, "role", ":x"),
    ]
    assert trie_rows(spark, turns) == brute_trie([t for t in turns if t[0] is not None])
    assert trie_rows(spark, []) == []


def test_trie_keeps_clashing_columns_out(spark):
    turns = spark.createDataFrame([(1, 1, "a", "b", 7)], TURNS + ", depth long")
    trie = prefix_trie(sequences(turns))
    assert rows(trie.nodes.select("depth", "n_convs", "n_leaves")) == [(0, 1, 1), (1, 1, 1)]
    assert [r["ends_sha256"] for r in ends_digests(trie.ends).collect()] == [hashlib.sha256(b"1").hexdigest()]


# --- quality rules -----------------------------------------------------------


def brute_base(text):
    words = WORD.findall(text or "")
    lines, seen, copies = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + s for k, w in enumerate(windows) if often[w] > 1 for s in range(3)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return (len(words), sum(map(len, words)), symbols, copies, len(covered))


def test_base_counts_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(None, None), (-1, ""), (-2, " \n\t\n "), (-3, "a b c a b c"), (-4, "a a a a"), (-5, "é#é\né#é\n x\n x\nx"),
           (-6, "same line\n" * 3), (-6, "same line\n" * 3), (-7, "   x"), (-8, "w " * 300_000)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    model = target_ratio.RatioModel(np.zeros(4096, np.int32))
    found = target_ratio.score_documents(docs, model).drop("score")
    wanted = [(r["doc_id"], *brute_base(r["text"])) for r in docs.collect()]
    assert rows(found) == sorted(wanted, key=repr)


def test_ratio_equals_counts_by_hand(spark):
    texts = [("a b a", True), ("a c", False), (None, True), ("", False)]
    docs = spark.createDataFrame(texts, "text string, chosen boolean")
    model = target_ratio.fit_weights(docs, F.col("chosen"))
    grams = [["a", "b", "a", "a b", "b a"], ["a", "c", "a c"]]  # no two share a cell
    every, trusted = Counter(grams[0] + grams[1]), Counter(grams[0])
    cells = len(model.weights)
    share = lambda n, total: np.log((n + 1) / (total + cells))
    weight = {g: round((share(trusted[g], 5) - share(every[g], 8)) * target_ratio.UNIT) for g in every}
    assert sorted(model.weights[model.weights != 0]) == sorted(w for w in weight.values() if w)
    scored = target_ratio.score_documents(docs.withColumn("doc_id", F.lit(1)), model)
    assert sorted(r["score"] for r in scored.collect()) == sorted(
        [sum(weight[g] for g in grams[0]) // 5, sum(weight[g] for g in grams[1]) // 3, 0, 0]
    )


def test_cells_grow_with_the_corpus():
    assert [target_ratio.cells_for(n) for n in (0, 10**8, 10**10, 10**14)] == [1 << 12, 1 << 16, 1 << 19, 1 << 26]


def test_threshold():
    class Fake:  # counts as Spark would give them
        def __init__(self, bins):
            self.bins = [dict(zip(("trusted", "bin", "count"), b, strict=True)) for b in bins]

        def groupBy(self, *_):
            return self

        count = groupBy

        def collect(self):
            return self.bins

    least = lambda bins: target_ratio.least_score(Fake(bins))
    assert least([]) is None and least([(False, 3, 9)]) is None
    assert least([(True, -40, 1), (True, 10, 999)]) == 10_000
    assert least([(True, -10, 100), (False, -60, 100)]) == -35_000
    assert least([(True, -10, 100), (False, 60, 100)]) == -10_000


def test_rules_on_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame(
        [(1, text, "x"), (1, text, "x"), (2, text, "x"), (None, text, "x"), (3, None, "x"), (4, "a b c " * 40, "x")],
        "doc_id long, text string, kept string",
    )
    found = target_ratio.apply_quality_rules(docs, labels, held_out("doc_id", 5, 0))
    seen = [(r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in found.collect()]
    assert sorted(seen, key=repr) == sorted(
        [(1, 60, False, True)] * 2 + [(2, 60, False, True), (None, 60, False, True), (3, 0, True, False), (4, 120, True, False)],
        key=repr,
    )
    assert target_ratio.apply_quality_rules(docs.limit(0), labels, held_out("doc_id", 5, 0)).collect() == []
    without = target_ratio.apply_quality_rules(docs, labels.limit(0), held_out("doc_id", 5, 0))
    assert sorted(r["kept"] for r in without.collect()) == [False, False, True, True, True, True]


def test_rules_tell_labelled_documents_apart(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = QUERIES["op12_target_ratio"](spark, sf_dir).drop("quality")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = found.join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    seen = {(r["quality"], r["kept"]): r["count"] for r in seen}
    good, bad = seen[1, True] / (seen[1, True] + seen.get((1, False), 0)), seen.get((0, True), 0)
    assert good >= 0.99 and bad <= 0.05 * (bad + seen[0, False])


# --- periodic runs -----------------------------------------------------------


def brute_runs(words, least=12):
    out = {}
    for lag in range(1, len(words) // 2 + 1):
        at = 0
        while at + lag < len(words):
            end = at
            while end + lag < len(words) and words[end] == words[end + lag]:
                end += 1
            if end - at >= max(lag, least - lag):
                out.setdefault((at, end + lag), lag)
            at = end + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def check_runs(texts):
    sizes, runs, collapsed = runs_of_texts(pa.array(texts, pa.string()), 12)
    for text, size, found, rest in zip(texts, sizes, runs, collapsed, strict=True):
        words = WORD.findall(text or "")
        wanted = brute_runs(words)
        assert size == len(words)
        assert [(r["start"], r["length"], r["period"]) for r in found] == wanted
        gone = {k for s, n, q in wanted for k in range(s + q, s + n)}
        assert rest.decode() == " ".join(w for k, w in enumerate(words) if k not in gone)


def fibonacci(size):
    one, two = "a", "ab"
    while len(two) < size:
        one, two = two, two + one
    return two[:size]


@pytest.mark.parametrize(
    "letters",
    ["", "a", "a" * 12, "a" * 11, "ab" * 300 + "a" + "ab" * 300, "a" * 400 + "b" + "a" * 400, fibonacci(1500),
     "".join("ab"[bin(k).count("1") % 2] for k in range(1200)), ("a" * 100 + "b") * 8,
     ("abc" * 60 + "ab" + "abc" * 70) * 3, ("ab" * 48 + "c") * 4 + ("ab" * 48 + "c")[:50]],
)
def test_runs_of_repetitive_words(letters):
    check_runs([" ".join(letters), " ".join(reversed(letters))])


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    draw, texts = random.Random(seed), [None, " \n ", "one"]
    for _ in range(40):
        size, kind = draw.randrange(900), draw.randrange(5)
        if kind == 0:
            s = draw.choices("ab", k=size)
        elif kind == 1:  # a long period with a few errors
            s = (draw.choices("ab" if draw.random() < 0.5 else "abcdefgh", k=draw.randrange(1, 200)) * 10)[:size]
            for _ in range(draw.randrange(4) if s else 0):
                s[draw.randrange(len(s))] = draw.choice("abz")
        elif kind == 2:  # many short periods
            s = []
            while len(s) < size:
                s += draw.choices("ab", k=draw.randrange(1, 6)) * draw.randrange(1, 40)
        elif kind == 3:  # runs inside runs
            inner = draw.choices("ab", k=draw.randrange(1, 5)) * draw.randrange(2, 30) + draw.choices("abc", k=draw.randrange(3))
            s = (draw.choices("ab", k=draw.randrange(20)) + inner * draw.randrange(2, 8)) * 2
        else:  # two runs of one period that touch
            word = draw.choices("ab", k=draw.randrange(1, 9)) * 200
            s = word[: draw.randrange(10, 200)] + word[draw.randrange(8) :][: draw.randrange(10, 200)]
            s += s[: draw.randrange(len(s))]
        texts.append(" ".join(s[:1000]))
    check_runs(texts)


def test_runs_of_a_long_text_take_little():
    size = 400_000
    ids = np.concatenate((np.tile(np.arange(1000), size // 1000), [-1])).astype(np.int32)
    assert find_runs(ids, np.array([size])).T.tolist() == [[0, size, 1000]]
    ids = np.concatenate((np.zeros(size), [1, 2])).astype(np.int32)
    assert find_runs(ids, np.array([size + 1])).T.tolist() == [[0, size, 1]]


def test_periodic_odd_rows(spark):
    odd = [(1, None, "x"), (2, "", "x"), (None, "a b " * 20, "x"), (None, "a b " * 20, "x"), (3, "é  " * 30, "x"),
           (7, "x " * 200_000, "x"), (8, "a\x0bb\x1cc", "x")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, runs string")
    found = rows(periodic_runs(docs).select("doc_id", "n_words", F.size("runs"), "collapsed"))
    assert found == sorted(
        [(1, 0, 0, ""), (2, 0, 0, ""), (None, 40, 1, "a b"), (None, 40, 1, "a b"), (3, 30, 1, "é "),
         (7, 200_000, 1, "x"), (8, 2, 0, "a b\x1cc")], key=repr)
    empty = run_digests(periodic_runs(with_made_runs(docs.limit(0))))
    assert empty.collect() == [] and "runs_sha256" in empty.columns
    none = run_digests(periodic_runs(docs.where("doc_id = 1"))).first()
    assert tuple(none) == (1, 0, None, None, None, None, EMPTY, EMPTY)
