"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are compared as sequences of lower-cased words. A text
meets an item where they share a seed, ``words`` words in a row. For such pairs
the longest common stretches are marked greedily, longest first and never
overlapping, found by running Karp-Rabin hashes; the share of the item's words
that get marked is its coverage. Passages in another order, or cut apart, are
covered all the same.

The benchmark is a stated set of queries. It is dealt into blocks of bounded
size, and each block goes to the executors once, over all texts.

Words are stretches of letters and digits; in scripts without spaces each character
is one. Work follows the words of a text and item and the number of tiles, not the
products of repeated words.

Defined results: NULL and empty texts and items match nothing; an item with fewer
words than a seed is found where all of them stand in a row, one of a single word
only in a text that holds nothing else; items are reported each, equal ones too;
rows and columns of the texts stay as they are; long texts are used whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodline.llm.arrays import ALPHANUMERIC, U64, mix, per_batch, powers, tokens, utf8

#: Words of a seed, and the least stretch that counts.
WORDS = 5
#: Share of an item's words that must be found in a text.
COVERAGE = 0.8
#: Bytes of benchmark text held by a task at once; more goes in further blocks.
BLOCK_BYTES = 16 << 20
MATCHES = "array<struct<item_id:{kind},coverage:double,tiles:int>>"
_TABLE_BITS = 20
#: Scripts written without spaces, whose letters count as words; their UTF-8 starts with such a byte or a greater one.
_SPACELESS = r"(\p{Han}|\p{Hiragana}|\p{Katakana}|\p{Thai}|\p{Lao}|\p{Khmer}|\p{Myanmar})"
_SPACELESS_HEAD = 0xE0
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words and the first one of every row (one more than rows)."""
    if pa.types.is_null(column.type):
        return np.zeros(0, U64), np.zeros(len(column) + 1, np.int64)
    lower = pc.utf8_lower(column)
    data, offsets = utf8(lower)
    if (data >= _SPACELESS_HEAD).any():
        data, offsets = utf8(pc.replace_substring_regex(lower, _SPACELESS, r" \1 "))
    starts, _, hashes = tokens(data, offsets, ALPHANUMERIC)
    return hashes, np.searchsorted(starts, offsets)


def seeds(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hash of the ``words`` words from each position on."""
    rolled = hashes
    for step in range(1, words):
        rolled = mix(rolled[: max(len(hashes) - step, 0)] * U64(0x9E3779B97F4A7C15) + hashes[step:])
    return rolled


def running_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` words, each from the one before by its ends.

    The hash of a window is a difference of two running sums, moved to the window's start.
    """
    if len(values) < size:
        return np.zeros(0, U64)
    up, down = powers(len(values), _BASE), powers(len(values), _BASE_INVERSE)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(mix(values + U64(1)) * up, dtype=U64, out=sums[1:])
    return (sums[size:] - sums[:-size]) * down[: len(values) - size + 1]


def tile(item, text, least: int) -> tuple[int, int]:
    """Words of ``item`` covered by greedy tiles of at least ``least`` words, and the tiles.

    ``text`` may contain -1, which equals nothing. The longest common stretch of
    words that no tile has taken becomes a tile, of several the first in the item
    and then in the text, until none of ``least`` words is left.
    """
    item, text = (np.asarray(v, object if any(x < 0 for x in v) else U64) for v in (item, text))
    cut = np.array([x == -1 for x in text], bool) if text.dtype == object else np.zeros(len(text), bool)
    text = np.where(cut, 0, text).astype(U64)
    return tiles_of(item.astype(U64), text, cut, least)


def tiles_of(item: np.ndarray, text: np.ndarray, cut: np.ndarray, least: int) -> tuple[int, int]:
    """:func:`tile` on arrays, ``cut`` marking the places of ``text`` that equal nothing.

    The search length is the greatest at which a window of untaken words of the
    item has the hash of one of the text; where there is one, there is one of every
    lesser length. Lengths only fall from tile to tile, so a tile mostly
    takes one comparison of all windows; memory follows the words.
    """
    taken_i, taken_t = np.zeros(len(item), bool), cut.copy()
    covered = count = 0

    def spot(size: int) -> tuple[int, int] | None:
        free_i, free_t = (untaken(t, size) for t in (taken_i, taken_t))
        ours, theirs = running_hashes(item, size), running_hashes(text, size)
        found = np.flatnonzero(free_i & np.isin(ours, theirs[free_t]))
        if not len(found):
            return None
        return int(found[0]), int(np.argmax(free_t & (theirs == ours[found[0]])))

    size = min(len(item), len(text))
    while size >= least:
        at = spot(size)
        if at is None:
            low, high = least - 1, size  # the greatest length with a spot lies from low to below high
            while high - low > 1:
                middle = (low + high) // 2
                tried = spot(middle)
                if tried is None:
                    high = middle
                else:
                    low, at = middle, tried
            if at is None:
                break
            size = low
        taken_i[at[0] : at[0] + size] = True
        taken_t[at[1] : at[1] + size] = True
        covered += size
        count += 1
    return covered, count


def untaken(taken: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of ``size`` words holds no taken one."""
    whole = np.concatenate(([0], np.cumsum(taken)))
    return whole[size:] == whole[: len(whole) - size]


@dataclass
class Seeds:
    """The windows of one size of the items: hashes in order, the item and place of each, and a table of hash heads."""

    values: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    table: np.ndarray


@dataclass
class Index:
    """One block of the benchmark. Items shorter than a seed are a seed of their own length."""

    ids: list
    items: list[np.ndarray]
    seeds: dict[int, Seeds]


def build_index(ids: list, texts: list[str | None], words: int) -> Index:
    hashes, first = word_hashes(pa.array(texts, pa.string()))
    items = [hashes[first[k] : first[k + 1]] for k in range(len(ids))]
    found = {}
    for size in sorted({min(words, len(i)) for i in items} - {0}):
        mine = [k for k, i in enumerate(items) if min(words, len(i)) == size]
        rolled = [seeds(items[k], size) for k in mine]
        values = np.concatenate(rolled)
        order = np.argsort(values, kind="stable")
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[(values >> U64(64 - _TABLE_BITS)).astype(np.int64)] = True
        owner = np.repeat(mine, [len(r) for r in rolled])
        place = np.concatenate([np.arange(len(r)) for r in rolled])
        found[size] = Seeds(values[order], owner[order], place[order], table)
    return Index(ids, items, found)


def marked(places: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of ``size`` words that starts at one of the places."""
    reach = np.zeros(total + 1, np.int64)
    np.add.at(reach, places, 1)
    np.add.at(reach, places + size, -1)
    return np.cumsum(reach)[:-1] > 0


def matches(
    index: Index, size: int, own: np.ndarray, rolled: np.ndarray, at: np.ndarray, words: int, coverage: float
) -> list[dict]:
    """Items covered by one text; ``at`` are the positions of its seeds of ``size`` words found in the index."""
    found = index.seeds[size]
    values, number = np.unique(rolled[at], return_inverse=True)
    low, high = np.searchsorted(found.values, values, "left"), np.searchsorted(found.values, values, "right")
    spots = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(int((high - low).sum()))
    of_value = np.repeat(np.arange(len(values)), high - low)
    owners = found.owner[spots]
    out = []
    for k in np.unique(owners):
        item = index.items[k]
        mine = owners == k
        if size < words:  # the whole item is the seed; a single word has to be the whole text
            if len(item) > 1 or len(own) == 1:
                out.append({"item_id": index.ids[k], "coverage": 1.0, "tiles": 1})
            continue
        if np.count_nonzero(marked(np.unique(found.place[spots[mine]]), size, len(item))) < coverage * len(item):
            continue  # tiles consist of seeds, so they cannot cover more
        shared = np.zeros(len(values), bool)
        shared[of_value[mine]] = True
        inside = np.flatnonzero(marked(np.unique(at[shared[number]]), size, len(own)))
        gaps = np.flatnonzero(np.diff(inside) != 1) + 1  # a place that equals nothing parts two regions
        text = np.insert(own[inside], gaps, U64(0))
        cut = np.insert(np.zeros(len(inside), bool), gaps, True)
        covered, tiles = tiles_of(item, text, cut, size)
        if covered >= coverage * len(item):
            out.append({"item_id": index.ids[k], "coverage": covered / len(item), "tiles": tiles})
    return out


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    words: int = WORDS,
    coverage: float = COVERAGE,
    name: str = "matches",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows and columns, with an array of the benchmark items found in the text.

    The array holds ``item_id``, ``coverage`` and the number of ``tiles``, by item.
    """
    kept = [c for c in docs.columns if c != name]
    kind = benchmark.schema[item].dataType.simpleString()
    items = benchmark.where(F.col(item_text).isNotNull()).select(
        F.col(item).alias("item"), F.col(item_text).alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    out = docs.select(*kept).withColumn(name, F.expr(f"cast(array() as {MATCHES.format(kind=kind)})"))
    schema = out.schema
    place = kept.index(text)
    for block in range(blocks):
        chosen = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        rows = sorted(((r["item"], r["text"]) for r in chosen.collect()), key=repr)
        index = build_index([r[0] for r in rows], [r[1] for r in rows], words)
        out = search(out, index, schema, place, words, coverage)
    return out


def search(
    docs: DataFrame, index: Index, schema, place: int, words: int, coverage: float
) -> DataFrame:
    """Append the matches in one block of the benchmark to the last column."""
    names = [f.name for f in schema]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, first = word_hashes(batch.column(place))
        found = None
        for size, known in index.seeds.items():
            rolled = seeds(hashes, size)
            hits = np.flatnonzero(known.table[(rolled >> U64(64 - _TABLE_BITS)).astype(np.int64)])
            spots = np.minimum(np.searchsorted(known.values, rolled[hits]), len(known.values) - 1)
            hits = hits[known.values[spots] == rolled[hits]]
            row = np.searchsorted(first, hits, "right") - 1
            inside = hits + size <= first[row + 1]
            hits, row = hits[inside], row[inside]
            if not len(hits):
                continue
            if found is None:
                found = batch.column(len(names) - 1).to_pylist()
            for k in np.unique(row):
                own = slice(first[k], first[k + 1])
                at = hits[row == k] - first[k]
                found[k] = found[k] + matches(index, size, hashes[own], rolled[own.start : own.stop], at, words, coverage)
        if found is None:
            return batch
        found = [sorted(f, key=lambda m: repr(m["item_id"])) for f in found]
        last = pa.array(found, type=batch.schema.field(len(names) - 1).type)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], last], schema=batch.schema)

    return per_batch(docs, work, schema)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``key, item_id, coverage, tiles`` for every text and every item it contains."""
    text = options.get("text", "text")
    found = with_matches(docs.select(key, text), benchmark, name="__found", **options)
    return found.select(key, F.inline("__found"))
