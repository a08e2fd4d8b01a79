"""Near duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Each text has two small collections of bundles of minhashes. A table key is one
bundle of the first with one of the second, so ``m`` bundles in each give ``m``
times ``m`` tables for the minhashes of ``2 m``. A key can only be shared where
both of its bundles are, so bundles nobody shares are left out before keys are
formed. Rows sharing a key form candidate groups. Large groups are sieved first: texts
of one template share keys by chance though they are far from alike, and would be
tied together, so their members are compared by one byte of every minhash and the group
falls apart into those that agree often enough. Within a group the shingle
sets themselves decide, tile by tile, and each tile returns only the links that
join its members, not its pairs.

Both sides of every join here grow with the corpus, so all are sort-merge joins.

Texts with equal shingle sets are collapsed to one representative first, so
exact copies never meet each other. Components follow from the confirmed links.

Defined results: ASCII letters are lower-cased and words are runs without ASCII
white space; a text with fewer words than a shingle has one shingle, all its
words; a text without words (or NULL) has an empty set, links with nothing and is
its own component; rows with a NULL id link with nothing and have a NULL
component; repeated rows with one id keep their rows and share a component if
their texts link; long texts are used whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broodline.llm.arrays import PLAIN_WORDS, U64, ascii_lower, mix, per_batch, tokens, utf8
from broodline.llm.graph import connected_components, settled
from broodline.operators.joins import spread

#: Minhashes in a bundle.
BUNDLE = 3
#: The share of pairs at exactly the threshold that the tables may miss.
MISSED = 5e-4
#: Sets of one tile; two tiles meet in one group.
TILE = 64
#: The share of pairs at exactly the threshold whose minhashes may agree too rarely for the sieve.
SIEVED = 1e-4
#: Minhashes that the sieve compares, those of the bundles among them.
SIEVE_MINHASHES = 96
#: Members of one tile of the sieve.
SIEVE_TILE = 4096
#: Bits of the bitmap of candidate ids, as a power of two.
MEMBER_BITS = 25


def bundles_needed(threshold: float) -> int:
    """Bundles in each collection so that a pair at the threshold is found but for ``MISSED``."""
    alone = 1 - threshold**BUNDLE
    count = 1
    while 2 * alone**count > MISSED:
        count += 1
    return count


def sieve_minhashes(bundles: int) -> int:
    """Minhashes with a byte of their own: all of the bundles, and more where those are few."""
    return max(SIEVE_MINHASHES, 2 * bundles * BUNDLE)


def agreements_needed(threshold: float, minhashes: int) -> int:
    """Minhashes that two texts at the threshold have in common but for a share of ``SIEVED``."""
    missed, count = 0.0, 0
    while True:
        missed += math.comb(minhashes, count) * threshold**count * (1 - threshold) ** (minhashes - count)
        if missed > SIEVED:
            return count
        count += 1


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles and the first one of each row (one more than rows)."""
    starts, _, hashes = tokens(ascii_lower(data), offsets, PLAIN_WORDS)
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    rolled = hashes
    for step in range(1, words):
        rolled = mix(rolled[: max(len(hashes) - step, 0)] * U64(0x9E3779B97F4A7C15) + hashes[step:])
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(begins[-1], U64)
    full = np.flatnonzero(counts >= words)
    if len(full):
        inside = np.repeat(first[full], sizes[full]) + (
            np.arange(sizes[full].sum()) - np.repeat(np.cumsum(sizes[full]) - sizes[full], sizes[full])
        )
        target = np.repeat(begins[full], sizes[full]) + inside - np.repeat(first[full], sizes[full])
        out[target] = rolled[inside]
    for row in np.flatnonzero((counts > 0) & (counts < words)):
        value = U64(counts[row])
        for h in hashes[first[row] : first[row + 1]]:
            value = mix(np.array([value], U64) ^ h)[0] + U64(words)
        out[begins[row]] = value
    return out, begins


def signature_columns(part: pa.Array, words: int, count: int) -> list[pa.Array]:
    """n, digest, the bundles of both collections and a byte of each minhash of every row."""
    values, begins = shingles(*utf8(part), words)
    rows = len(part)
    sizes = np.zeros(rows, np.int64)
    digests: list[bytes | None] = [None] * rows
    for row in range(rows):
        if begins[row + 1] > begins[row]:
            own = np.unique(values[begins[row] : begins[row + 1]])
            sizes[row] = len(own)
            sums = [own.sum(dtype=U64), mix(own ^ U64(0xA5A5)).sum(dtype=U64)]
            digests[row] = np.array([len(own), *sums], U64).tobytes()
    filled = np.flatnonzero(sizes)
    out = np.zeros((2 * count, rows), U64)
    minhashes = sieve_minhashes(count)
    heads = np.zeros((rows, minhashes), np.uint8)
    draws = mix(np.arange(1, minhashes + 1, dtype=U64))
    if len(filled):
        at = begins[:-1][filled]
        for collection in range(2 * count):
            key = np.full(len(filled), collection + 1, U64)
            for turn in range(BUNDLE):
                draw = draws[collection * BUNDLE + turn]
                least = np.minimum.reduceat((values ^ draw) * (draw | U64(1)), at)
                key = mix(key + least)
                heads[filled, collection * BUNDLE + turn] = mix(least) >> U64(56)
            out[collection, filled] = key
        for place in range(2 * count * BUNDLE, minhashes):
            least = np.minimum.reduceat((values ^ draws[place]) * (draws[place] | U64(1)), at)
            heads[filled, place] = mix(least) >> U64(56)
    keys = out.view(np.int64)
    ends = pa.array(np.arange(rows + 1) * count, pa.int32())
    sides = [
        pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(side.T).reshape(-1)))
        for side in (keys[:count], keys[count:])
    ]
    return [pa.array(sizes), pa.array(digests, pa.binary()), *sides, pa.array([h.tobytes() for h in heads], pa.binary())]


def signatures(docs: DataFrame, words: int, threshold: float, key: str, text: str) -> DataFrame:
    """``doc, n, digest, a, b, heads`` of every row."""
    count = bundles_needed(threshold)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = signature_columns(batch.column(1), words, count)
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", "n", "digest", "a", "b", "heads"])

    chosen = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    return per_batch(
        chosen, work, "doc long, n long, digest binary, a array<long>, b array<long>, heads binary"
    )


def shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows (``rep`` and a key) whose key has several ``rep``, with the least as ``centre``."""
    groups = rows.groupBy(key).agg(F.min("rep").alias("centre"), F.max("rep").alias("__last"))
    groups = groups.where("centre < __last").drop("__last")
    return rows.join(groups.hint("merge"), key)


def candidate_edges(reps: DataFrame) -> DataFrame:
    """``a, b``: edges that tie each representative to the least one of every table key it shares.

    The least ones of a representative, at most one for each table, are tied to the
    least of them, so a group of copies gives little more than an edge for each member.
    """
    sides = []
    for side in ("a", "b"):
        rows = reps.select("rep", F.explode(side).alias("key"))
        sides.append(shared(rows, "key").select("rep", F.lit(side).alias("side"), "key"))
    left = sides[0].unionByName(sides[1]).groupBy("rep").agg(
        F.collect_set(F.when(F.col("side") == "a", F.col("key"))).alias("a"),
        F.collect_set(F.when(F.col("side") == "b", F.col("key"))).alias("b"),
    )
    crossed = left.select("rep", F.explode("a").alias("x"), "b").select("rep", "x", F.explode("b").alias("y"))
    tables = crossed.select("rep", F.xxhash64("x", "y").alias("key"))
    centres = shared(tables, "key").groupBy("rep").agg(F.collect_set("centre").alias("centres"))
    least = F.array_min("centres")
    tied = centres.select(F.explode(F.array_append("centres", F.col("rep"))).alias("a"), least.alias("b"))
    return tied.where("a <> b").distinct()


def groups_in_order(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """Rows of equal keys, from batches ordered by the keys; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            if stop == start:
                continue
            key = tuple(c[start] for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def agreeing(heads: np.ndarray, side: np.ndarray, needed: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows that agree in ``needed`` places or more.

    ``side`` parts the rows in two; with both sides, only pairs across count. Each
    row reached is compared with the rows not reached yet, all at once.
    """
    across = side.any() and not side.all()
    open_ = np.ones(len(heads), bool)
    out = []
    for start in range(len(heads)):
        if not open_[start]:
            continue
        open_[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            others = np.flatnonzero(open_ & (side != side[at]) if across else open_)
            near = others[np.count_nonzero(heads[others] == heads[at], axis=1) >= needed]
            open_[near] = False
            found = near.tolist()
            out += [(at, k) for k in found]
            todo += found
    return out


def sieved(groups: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """``node, component`` again, the components of more than ``TILE`` nodes split by agreement of minhashes.

    Nodes of a large component are dealt into tiles, every two of which meet once;
    a task holds two tiles of minhash bytes. Nodes left alone drop out.
    """
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = settled(groups.join(sizes.hint("merge"), "component"), "groups")
    large = sized.where(F.col("size") > TILE).withColumn("tiles", F.ceil(F.col("size") / SIEVE_TILE).cast("int"))
    rows = large.join(reps.select(F.col("rep").alias("node"), "heads").hint("merge"), "node")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    met = rows.withColumn("other", other).select(
        "node", "component", F.least("tile", "other").alias("tile_l"), F.greatest("tile", "other").alias("tile_r"), "tile", "heads"
    )
    keys = ["component", "tile_l", "tile_r"]
    ordered = spread(met, *keys).sortWithinPartitions(*keys, "node")
    needed = agreements_needed(threshold, sieve_minhashes(bundles_needed(threshold)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, keys):
            nodes = group.column("node").to_numpy()
            heads = np.frombuffer(b"".join(group.column("heads").to_pylist()), np.uint8).reshape(len(nodes), -1)
            side = group.column("tile").to_numpy() != group.column("tile_l")[0].as_py()
            found = np.array(agreeing(heads, side, needed), np.int64).reshape(-1, 2)
            if len(found):
                columns = [pa.array(nodes[found[:, 0]]), pa.array(nodes[found[:, 1]])]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    split = connected_components(ordered.mapInArrow(judge, "a long, b long"))
    return sized.where(F.col("size") <= TILE).select("node", "component").unionByName(split.select("node", "component"))


def links_within(
    ids: list[int], sets: list[np.ndarray], side: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Links that join the members of one group: a spanning forest of all its links.

    ``side`` parts the members in two; where both sides occur, links inside a side are
    told elsewhere, so only links across that join what those leave apart are returned.
    """
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(fresh) - 1
    common = np.bincount(column)[column] > 1
    column, owner = column[common], owner[common]
    both = np.zeros((len(sets), len(sets)), np.float32)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        for start in range(0, int(column[-1]) + 1, 8192):
            lo, hi = np.searchsorted(column, (start, start + 8192))
            grid = np.zeros((len(sets), min(8192, int(column[-1]) + 1 - start)), np.float32)
            grid[owner[lo:hi], column[lo:hi] - start] = 1
            both += grid @ grid.T
    both = np.rint(both).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    linked = np.triu(100 * both >= percent * union, 1)
    across = side[:, None] != side[None, :] if side.any() and not side.all() else np.ones_like(linked)
    out = []
    for told, pairs in ((False, linked & ~across), (True, linked & across)):
        for i, j in zip(*np.nonzero(pairs), strict=True):
            a, b = root(int(i)), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                if told:
                    out.append((ids[i], ids[j]))
    return out


def likely_member(grouped: DataFrame) -> Column:
    """True for every id (``rep``) in ``grouped`` and for few others.

    A bitmap of fixed size, so texts that are no candidates stay out of the shuffle;
    a full bitmap only keeps more of them in.
    """
    place = F.pmod(F.xxhash64("rep"), F.lit(1 << MEMBER_BITS))
    words = grouped.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(63).alias("bit"))
    mask = F.expr("shiftleft(1L, cast(bit as int))")
    found = words.groupBy("word").agg(F.bit_or(mask).alias("mask")).toArrow()
    bitmap = np.zeros(1 << (MEMBER_BITS - 6), np.int64)
    bitmap[found.column(0).to_numpy()] = found.column(1).to_numpy()

    @F.pandas_udf("boolean")
    def member(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((bitmap[at >> 6] >> (at & 63)) & 1 == 1)

    return F.col("rep").isNotNull() & member(place)


def confirmed_links(
    docs: DataFrame, grouped: DataFrame, words: int, percent: int, key: str, text: str
) -> DataFrame:
    """Links ``a, b`` within candidate groups, found on whole shingle sets.

    ``grouped`` has ``rep, digest, blob, tile, tiles``. A group of up to ``TILE``
    sets is judged at once; a larger one is cut into tiles and every two tiles
    meet once, so a task never holds more than two tiles.
    """
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    texts = texts.where(F.col("text").isNotNull() & likely_member(grouped))
    texts = texts.join(grouped.hint("merge"), "rep")

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, begins = shingles(*utf8(batch.column("text")), words)
        wanted = batch.column("digest").to_pylist()
        rows, found = [], []
        for row in range(batch.num_rows):
            own = np.unique(values[begins[row] : begins[row + 1]])
            sums = [own.sum(dtype=U64), mix(own ^ U64(0xA5A5)).sum(dtype=U64)]
            if np.array([len(own), *sums], U64).tobytes() == bytes(wanted[row]):
                rows.append(row)
                found.append(own.tobytes())
        keep = batch.select(["rep", "blob", "tile", "tiles"]).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [*keep.columns, pa.array(found, pa.binary())], ["rep", "blob", "tile", "tiles", "shingles"]
        )

    sets = per_batch(
        texts.select("text", "rep", "digest", "blob", "tile", "tiles"),
        sets_of,
        "rep long, blob long, tile int, tiles int, shingles binary",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    met = sets.withColumn("other", other).select(
        "rep",
        "blob",
        F.least("tile", "other").alias("tile_l"),
        F.greatest("tile", "other").alias("tile_r"),
        "tile",
        "shingles",
    )
    keys = ["blob", "tile_l", "tile_r"]
    ordered = spread(met, *keys).sortWithinPartitions(*keys, "rep")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, keys):
            ids = group.column("rep").to_pylist()
            own = {i: k for k, i in reversed(list(enumerate(ids)))}
            rows = sorted(own.values())
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(group.column("shingles")[k].as_py(), U64) for k in rows]
            side = np.array([group.column("tile")[k].as_py() for k in rows]) != group.column("tile_l")[0].as_py()
            found = links_within([ids[k] for k in rows], sets, side, percent)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return ordered.mapInArrow(judge, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Two texts link if the intersection of their ``words``-word shingle sets is at
    least ``percent`` hundredths of the union.
    """
    signed = settled(signatures(docs, words, percent / 100, key, text), "signatures")
    usable = signed.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    reps = usable.groupBy("digest").agg(
        F.min("doc").alias("rep"), *[F.any_value(c).alias(c) for c in ("a", "b", "heads")]
    )
    reps = settled(reps, "representatives")
    groups = settled(sieved(connected_components(candidate_edges(reps)), reps, percent / 100), "sieved")
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    grouped = (
        groups.join(sizes.hint("merge"), "component")
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .select(F.col("node").alias("rep"), F.col("component").alias("blob"), "tile", "tiles")
        .join(reps.select("rep", "digest").hint("merge"), "rep")
    )
    grouped = settled(grouped, "candidates")
    links = confirmed_links(docs, grouped, words, percent, key, text)
    parts = connected_components(links)
    named = (
        reps.select("rep", "digest")
        .join(parts.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
        .select("digest", F.coalesce("component", "rep").alias("component_id"))
    )
    rows = signed.select("doc", "n", "digest")
    joined = rows.join(named.hint("merge"), "digest", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return joined.select(
        F.col("doc").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"),
    )
