"""Operators for training data: edge cases, and whole results against brute force on small tables."""

import hashlib
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from broodline.llm import decontaminate, fingerprints, html_extract, near_dup, packing, token_files
from broodline.llm.arrays import PLAIN_WORDS, held_out, tokens, utf8
from broodline.llm.graph import connected_components
from broodline.llm.language_id import LanguageModel, fit_language_model, identify_language
from broodline.llm.licences import TEMPLATES, fit_licences, scan_licences
from broodline.llm.quality import fit_quality, score_quality
from broodline.llm.tokenizing import Encoder, encoder
from broodline.llm.toxicity import fit_toxicity, score_toxicity
from conftest import rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, lang string, score string"
#: NULL and empty texts, no words, repeated rows, a NULL id, a long text, clashing columns.
ODD = [
    (1, None, "en", "x"),
    (2, "", None, "x"),
    (3, " \n\t ", "de", None),
    (4, "one two", "en", "x"),
    (4, "one two", "en", "x"),
    (None, "no id here at all", None, "x"),
    (6, "12 34 !! 56", "fr", "x"),
    (7, "long " * 60_000, "en", "x"),
    (8, "é à ü ß a b ¿que?", "es", "x"),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def always():
    return F.lit(True)


def test_token_spans_and_hashes():
    texts = ["a b", "", "b  a\n", "ab" * 5, "c"]
    data, offsets = utf8(pa.array(texts))
    starts, ends, hashes = tokens(data, offsets, PLAIN_WORDS)
    found = [bytes(data[s:e]).decode() for s, e in zip(starts, ends, strict=True)]
    assert found == ["a", "b", "b", "a", "ab" * 5, "c"]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and len(set(hashes)) == 4


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (6, 6)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert rows(found) == [(3, 3), (4, 3), (5, 3), (7, 7), (8, 7), (9, 3)]
    chain = [(k, k + 1) for k in range(200)]
    found = connected_components(spark.createDataFrame(chain, "a long, b long"))
    assert {r["component"] for r in found.collect()} == {0} and found.count() == 201


# --- near duplicates ---------------------------------------------------------


def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute_components(texts, n, percent):
    sets = {i: shingle_set(t, n) for i, t in texts}
    parent = {i: i for i in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent):
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for group in range(8):
        base = draw.choices(vocabulary, k=draw.choice([4, 40, 200]))
        for _ in range(90 if group == 0 else 9):
            text = list(base)
            for _ in range(draw.choice([0, 1, 2, 6, 20])):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            texts.append((len(texts), " ".join(text).title() if draw.random() < 0.3 else " ".join(text)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, words, percent).collect()}
    assert found == brute_components(texts, words, percent)


def test_near_duplicates_odd_rows(spark):
    found = near_dup.near_duplicates(odd(spark), words=3, percent=85)
    assert rows(found, "doc_id") == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True),
         (None, 3, None, True), (6, 2, 6, True), (7, 1, 7, True), (8, len(shingle_set(ODD[8][1], 3)), 8, True)], key=repr)
    assert near_dup.near_duplicates(nothing(spark)).collect() == []


# --- packing and token files -------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_tokenizer(name):
    encoder, plain = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    draw = random.Random(3)
    texts = ["", None, "it's a  b\n\nc \n d ", "<|endoftext|> x", "É é İ Σς ½²", "a  b \nc", "\x1c a"]
    texts += ["".join(draw.choices(" \n\taB'é1.日<|", k=draw.randrange(20))) for _ in range(500)]
    ids, begins = encoder.encode(pa.array(texts, pa.string()))
    for row, text in enumerate(texts):
        expected = plain.encode(text or "", add_special_tokens=False).ids
        assert ids[begins[row] : begins[row + 1]].tolist() == expected, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_operators_encode_added_tokens_as_the_file_does(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    draw = random.Random(8)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", " ", "a b", "\n", "É\u00a0", "<|ENDOFTEXT|>", ""]
    texts = ["a <|endoftext|> b", "<|endof", "text|> c", None, "", "plain  words\n", "<|endoftext|>"]
    texts += ["".join(draw.choices(bits, k=draw.randrange(5))) for _ in range(400)]
    for some in (texts, texts[:5], [t for t in texts if t and "\u00a0" not in t]):
        ids, begins = encoder(path).encode(pa.array(some, pa.string()))
        assert len(begins) == len(some) + 1
        for row, text in enumerate(some):
            expected = plain.encode(text or "", add_special_tokens=False).ids
            assert ids[begins[row] : begins[row + 1]].tolist() == expected, text


def test_plan_places_every_piece_once():
    draw = random.Random(1)
    counts = {}
    for _ in range(5000):
        length = min(2048, int(draw.lognormvariate(5.5, 1.2)) + 1)
        counts[length] = counts.get(length, 0) + 1
    packed = packing.plan(counts)
    placed = {}
    for pattern, times in packed:
        assert sum(pattern) <= 2048 and times > 0
        for length in pattern:
            placed[length] = placed.get(length, 0) + times
    assert placed == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in packed) <= math.ceil(total / 2048) * 1.01 + 1
    assert packing.plan({}) == []


def test_packing_and_files_round_trip(spark):
    gpt, word = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    df = odd(spark)
    found = packing.pack(df, gpt).collect()
    plain = Tokenizer.from_file(gpt)
    expected = sorted(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _, _ in ODD)
    by_doc = {}
    for r in found:
        by_doc.setdefault((r["doc_id"], r["ids_crc32"] if r["doc_id"] == 4 else 0), []).append(r)
    assert sum(r["length"] for r in found) == sum(expected)
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(nothing(spark), gpt).collect() == []

    plain = Tokenizer.from_file(word)
    found = token_files.round_trip(df, word).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    at, expected = 0, []
    for doc, text, _, _ in order:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in found), key=repr) == sorted(expected, key=repr)
    assert token_files.round_trip(nothing(spark), word).collect() == []


@pytest.mark.parametrize("width,count", [(0, 5), (1, 64), (7, 1000), (16, 16384), (31, 130), (32, 65)])
def test_blocks_round_trip(width, count):
    draw = np.random.default_rng(width)
    values = draw.integers(0, 1 << width, count, dtype=np.uint64).astype("<u4") if width else np.full(count, 9, "<u4")
    if count > 100:
        values[::50] = 0xFFFFFFFF  # exceptions
    assert np.array_equal(token_files.decode_block(memoryview(token_files.encode_block(values)), 0), values)


# --- decontamination ---------------------------------------------------------


def test_decontamination_finds_reordered_passages(spark):
    item = [f"b{k}" for k in range(40)]
    other = [f"c{k}" for k in range(40)]
    filler = [f"f{k}" for k in range(30)]
    texts = [
        (1, " ".join(filler + item + filler)),
        (2, " ".join(item[20:] + filler + item[:20]).upper()),
        (3, " ".join(filler + item[:20] + filler)),
        (4, ", ".join(item[:16] + ["x"] + item[17:])),
        (5, " ".join(x for pair in zip(item, other, strict=True) for x in pair)),
        (6, None),
        (None, " ".join(item)),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(10, " ".join(item)), (11, "b1 b2 b3"), (12, None), (13, " ".join(other))], "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 200):
        found = decontaminate.contaminated_pairs(docs, items, block_bytes=block)
        assert rows(found.select("doc_id", "item_id", F.round("coverage", 3), "tiles")) == sorted(
            [(1, 10, 1.0, 1), (2, 10, 1.0, 2), (4, 10, 0.975, 2), (None, 10, 1.0, 1),
             *((d, 11, 1.0, 1) for d in (1, 2, 3, 4, None))], key=repr)
    assert decontaminate.contaminated_pairs(nothing(spark), items).collect() == []
    assert decontaminate.contaminated_pairs(docs, items.limit(0)).collect() == []


def test_tiles_never_overlap():
    draw = random.Random(2)
    for _ in range(200):
        item, text = ([draw.randrange(4) for _ in range(draw.randrange(1, 30))] for _ in range(2))
        covered, tiles = decontaminate.tile(item, text, 3)
        assert 3 * tiles <= covered <= min(len(item), len(text))
        common = any(item[i : i + 3] == text[j : j + 3] for i in range(len(item) - 2) for j in range(len(text) - 2))
        assert (covered > 0) == common


# --- fingerprints ------------------------------------------------------------


def test_fingerprints(spark):
    draw = random.Random(4)
    texts = [(k * 3, "".join(draw.choices("abcdefgh éß", k=draw.choice([0, 1, 5, 300, 5000])))) for k in range(60)]
    texts[7] = (21, texts[6][1])
    texts[9] = (27, None)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    found = sorted(fingerprints.fingerprints(df).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in found] == [t[0] for t in texts]
    for k, r in enumerate(found):
        own, following = texts[k][1] or "", texts[(k + 1) % len(texts)][1] or ""
        half = len(own) // 2
        changed = own[: len(own) - half] + following[:half]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if len(own) == 5000:
            assert 0.3 < r["near_edited"] < 0.7 or own == following
    assert found[6]["fingerprint"] == found[7]["fingerprint"] and found[6]["near_next"] == 1.0
    assert fingerprints.fingerprints(nothing(spark)).collect() == []
    assert fingerprints.fingerprints(odd(spark)).count() == len(ODD)


def test_fingerprints_keep_every_anchor_of_long_texts():
    draw = random.Random(6)
    some = lambda n: "".join(draw.choices("abcdefghij klmno", k=n))
    mark = lambda text: fingerprints.sketch(fingerprints.code_points([text])[0])
    shared = some(300)
    one, other = some(200_000) + shared + some(200_000), some(50_000) + shared + some(300_000)
    (a, at_a), (b, at_b) = (fingerprints.from_text(fingerprints.to_text(*mark(t))) for t in (one, other))
    both, rows_a, rows_b = np.intersect1d(a, b, return_indices=True)
    inside = (at_a[rows_a] >= 200_000) & (at_a[rows_a] < 200_300) & (at_b[rows_b] - at_a[rows_a] == -150_000)
    assert inside.sum() >= 50
    text = some(20_000)
    grown = text[:10_000] + some(4_000) + text[10_000:]
    assert abs(fingerprints.likeness(mark(text), mark(grown)) - 20 / 24) < 0.02


# --- classifiers -------------------------------------------------------------


def labelled(spark):
    draw = random.Random(9)
    sounds = {"en": ["the", "and", "with", "of"], "de": ["der", "und", "mit", "schön"], "fr": ["le", "et", "avec", "été"], "es": ["el", "y", "con", "niño"]}
    docs, labels = [], []
    for k in range(400):
        lang = list(sounds)[k % 4]
        words = draw.choices(sounds[lang] + [f"{s}{t}" for s in sounds[lang] for t in sounds[lang]], k=60)
        bad, mean = k % 5 == 0, k % 7 == 0
        if mean:
            words[10], words[30] = "idiotisch", "idiotisch"
        docs.append((k, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words), lang))
        labels.append((k, 0 if bad else 1, 1 if mean else 0))
    labels += [(None, 1, 1), (3, None, None)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_language(spark):
    docs, _ = labelled(spark)
    model = fit_language_model(docs, ~held_out("doc_id", 4, 2))
    assert sorted(map(sorted, model.families.values())) and sum(map(len, model.families.values())) == 4
    found = identify_language(docs, model).where(held_out("doc_id", 4, 2)).collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in found)
    strange = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_language(odd(spark), model).collect()}
    assert [strange[k] for k in (1, 2, 3, 6)] == [("und", 0.0)] * 4
    assert identify_language(nothing(spark), model).collect() == []
    untaught = fit_language_model(nothing(spark), always())
    assert untaught == LanguageModel()
    assert {r["lang_pred"] for r in identify_language(docs, untaught).collect()} == {"und"}


@pytest.mark.parametrize("fit,score,label", [(fit_quality, score_quality, "quality"), (fit_toxicity, score_toxicity, "toxic")])
def test_classifiers(spark, fit, score, label):
    docs, labels = labelled(spark)
    model = fit(docs, labels, ~held_out("doc_id", 5, 0))
    found = score(docs, model).join(labels, "doc_id").where(held_out("doc_id", 5, 0)).where(F.col(label).isNotNull())
    found = found.collect()
    right = sum((r["score"] >= 0.5) == (r[label] == 1) for r in found)
    assert right >= 0.95 * len(found)
    strange = score(odd(spark), model)
    assert strange.columns == ["doc_id", "text", "lang", "score"]
    assert all(0 <= r["score"] <= 1 for r in strange.collect()) and strange.count() == len(ODD)
    assert score(nothing(spark), model).collect() == []
    untaught = fit(docs, labels.limit(0), always())
    assert all(0 <= r["score"] <= 1 for r in score(docs, untaught).collect())


def test_licences(spark):
    model = fit_licences(spark)
    lines = [f"{opening} {notices[0]}." for opening in ("Our tool is", "") for notices in TEMPLATES.values()]
    plain = ["The licence plate was bent.", "A copyright dispute about songs.", "no cue word at all"]
    text = "\n".join(lines + plain)
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, family string")
    found = scan_licences(docs, model).collect()
    assert {r["doc_id"] for r in found} == {1}
    named = {r["paragraph"]: r["family"] for r in found}
    families = list(TEMPLATES) * 2
    assert [named[k] for k in range(len(families))] == families
    assert {named.get(k, "unknown") for k in range(len(families), len(lines + plain))} == {"unknown"}
    assert len(found) == 2 * len(named)
    assert "Python" not in scan_licences(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert scan_licences(nothing(spark), model).collect() == []


def test_licences_without_cue_words_and_identifiers(spark):
    model = fit_licences(spark)
    wanted = [
        ("All rights reserved.", "Proprietary"),
        ("(c) 2021 Example Ltd. All rights reserved!", "Proprietary"),
        ("Proprietary and confidential. Unauthorized copying of these pages is forbidden.", "Proprietary"),
        ("Photos: CC BY 4.0", "CC-BY"),
        ("CC0 1.0 Universal", "Public-Domain"),
        ("// SPDX-License-Identifier: MIT", "MIT"),
        ("# SPDX-License-Identifier: LGPL-2.1-only", "LGPL"),
        ("All people have rights.", "unknown"),
        ("Twelve pigeons slept under the old bridge.", "unknown"),
    ]
    text = "\n\n".join(line for line, _ in wanted) + "\n" + "unlisted words " * 20_000
    found = scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [(r["line"], r["family"]) for r in sorted(found, key=lambda r: r["paragraph"])[:-1]] == wanted
    assert len(found) == len(wanted) + 1


# --- pages -------------------------------------------------------------------


def page(k, extra=""):
    return (
        f"<html><head><title>T{k}</title><script>if (a<b) x('</p>')</script></head><body><nav><a href=/>Home</a></nav>"
        f"<div class='cookie-notice'>We use cookies</div><article><h1>Head&nbsp;{k}</h1><p>First  <b>para</b>\n{k} &amp; more"
        f"<p>Second&lt;{k}&gt;<br>line{extra}<form>Subscribe {k}</form></article><div id=comments><p>me too {k}</div>"
        f"<aside>Side {k}</aside><footer>End</footer></body></html>"
    )


def test_main_text(spark):
    data = [(k, "https://a.example/x", page(k)) for k in range(6)]
    data += [(10, None, None), (11, "bad url", ""), (12, "https://a.example/y", page(12, "<ul><li><a>one</a><li><a>two</a></ul>")), (0, "https://a.example/x", page(0)), (13, "https://a.example/z", page(13)[:-150])]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in html_extract.extract_main_text(df).collect()}
    for k in (0, 3, 12):
        assert found[k]["text"] == f"Head {k}\nFirst para {k} & more\nSecond<{k}> line"
        assert found[k]["n_chars"] == len(found[k]["text"])
    assert found[10]["text"] == found[11]["text"] == "" and found[13]["text"]
    assert html_extract.extract_main_text(df).count() == len(data)
    assert html_extract.extract_main_text(df.limit(0)).collect() == []


def test_wrapper_and_pages_without_regions():
    pages = [
        f"<body><div class=a><a href=x>Home</a><a>About</a></div><div><h2>T{k}</h2>{'<p>Text number %d goes on.</p>' % k * (k + 1)}"
        f"<p>Last {k}</p></div><div class=z>All rights reserved</div></body>"
        for k in range(5)
    ]
    wrapper = html_extract.infer_wrapper(pages)
    assert html_extract.expression(wrapper) == (
        "<#root><body><div.a>(<a>#TEXT</>)+</><div><h2>#TEXT</>(<p>#TEXT</>)+</><div.z>'All rights reserved'</></></>"
    )
    assert html_extract.main_text(pages[1], wrapper) == "T1\nText number 1 goes on.\nText number 1 goes on.\nLast 1"


def test_articles_keep_constant_texts_all_regions_and_named_parts():
    pages = [
        f"<body><article><h1>Head {k}</h1><h2>Background</h2>"
        f"<section id='legal-history'><p>History {k}</p></section><p class=notice>Kept {k}</p>"
        f"<div class='cookie-notice'>Cookies {k}</div></article><article><p>Second part</p></article>"
        f"<div class=comments><article><p>me too {k}</p></article></div></body>"
        for k in range(5)
    ]
    wrapper = html_extract.infer_wrapper(pages)
    assert html_extract.main_text(pages[2], wrapper) == "Head 2\nBackground\nHistory 2\nKept 2\nSecond part"
    variants = [
        f"<body data-v={k}><nav>Home of news</nav><p>menu {k}</p><article><h2>Home of news</h2><p>The same notice.</p></article></body>"
        for k in range(4)
    ]
    assert html_extract.main_text(variants[0], html_extract.infer_wrapper(variants)) == "The same notice."


def test_copies_of_a_page_take_one_place_of_the_choice(spark):
    pages = [f"<body><div><b>Menu of the site</b></div><p>Text {k} of the page.</p></body>" for k in range(4)]
    data = [(k, "https://a.example/x", html) for k, html in enumerate(pages * 30)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    found = html_extract.extract_main_text(df).collect()
    assert len(found) == len(data)
    assert {r["text"] for r in found} == {f"Text {k} of the page." for k in range(4)}
    wrappers = html_extract.layout_wrappers(df, "url", "html").collect()
    assert [len(html_extract.decoded(r["wrapper"])[html_extract.MARKS]) for r in wrappers] == [3]
