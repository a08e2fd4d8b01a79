"""The trie of conversation prefixes, built from sorted neighbours.

Conversations become sequences of turn digests and are dealt by ranges of their
sorted order; equal ones are dealt by id, so a group of copies of any size spreads
over many ranges. Within a range every two neighbours give an edge of the depth
to which they agree. Union-find takes the edges from the deepest on: each merge
of two components at a new depth is a branching node with the merged components'
top nodes below it. Chains of single children lie between.

Nodes that a range shares with the one before or behind it are the prefixes of its
first or last sequence, down to the depth at which the ranges agree. Each range
contracts everything below them to sums, counting a shared node in the first
range that holds it (a childless one in the last), and the sums of all ranges are
merged by the digest of the prefix. Texts are only read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broodline.llm.graph import settled

#: Bytes of a digest.
WIDTH = 16
#: Turns that a range is meant to hold at most.
TURNS_PER_RANGE = 1_000_000
#: Nodes in an Arrow batch.
NODES = 50_000

ROOT = bytes(WIDTH)
SCHEMA = (
    "part int, shared boolean, node binary, parent binary, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends array<long>"
)
_KINDS = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.list_(pa.int64())]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class Trie:
    """``nodes`` has one row for each prefix; ``ends`` the ids that end in a node, a list for each range.

    ``nodes``: ``node, parent`` (digests), ``depth, conv_id`` (smallest member),
    ``parent_conv_id, n_convs, n_children, n_leaves, saved_tokens``. ``ends``:
    ``node, part, conv_ids``; the lists of a node, by ``part``, are ascending.
    """

    nodes: DataFrame
    ends: DataFrame


def sequences(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, marks``: the turns of every conversation in order, each with a digest and its words.

    Ordered by turn, NULL first; equal turns by role and then by digest, so any
    order of rows gives the same result and repeated rows stay. NULL roles and
    texts read as empty ones; rows without a conversation are left out.
    """
    said, who = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    mark = F.substring(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256), 1, 2 * WIDTH)
    words = F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), who.alias("role"), mark.alias("mark"), words.alias("words")).alias("row"),
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return listed.select(
        "conv_id", F.transform("rows", lambda r: F.struct(r["mark"].alias("mark"), r["words"].alias("words"))).alias("marks")
    )


def with_shared_starts(found: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Sequences whose first h turns are those of conversation c - c % ``every``; h is CRC-32 of c modulo ``most`` + 1.

    All of that conversation's turns if it has fewer, none if there is none. The
    conversation's own first h turns go.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    starts = found.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("marks", 1, most).alias("start")
    )
    taken = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    rows = found.withColumns({"base": base, "h": taken}).join(starts, "base", "left")
    own = F.slice("marks", F.col("h") + 1, F.greatest(F.size("marks"), F.lit(1)))
    head = F.slice(F.coalesce("start", F.slice("marks", 1, 0)), F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(head, own).alias("marks"))


def agreement(one: bytes, other: bytes) -> int:
    """Turns in which two sequences agree from the start on."""
    size = min(len(one), len(other))
    differs = np.frombuffer(one, np.uint8, size) != np.frombuffer(other, np.uint8, size)
    at = int(differs.argmax()) if size else 0
    return (at if size and differs[at] else size) // WIDTH


class _Forest:
    """The prefixes of one range, read in sorted order."""

    def __init__(self, part: int, before: int, behind: int) -> None:
        self.part, self.before, self.behind = part, before, behind
        self.convs: list[int] = []
        self.depths: list[int] = []
        self.agree: list[int] = []  # depth of agreement with the row before
        self.fresh: list[list[bytes]] = []  # digests of the nodes that a row is the first to have
        self.words: list[list[int]] = []
        self.above: list[bytes] = []  # the node over those
        self.path = [ROOT]
        self.last = b""

    def add(self, conv: int, seq: bytes, words: list[int]) -> None:
        depth = len(seq) // WIDTH
        shared = agreement(self.last, seq)
        path = self.path
        del path[shared + 1 :]
        for at in range(shared, depth):
            path.append(hashlib.blake2b(path[-1] + seq[at * WIDTH : (at + 1) * WIDTH], digest_size=WIDTH).digest())
        self.convs.append(conv)
        self.depths.append(depth)
        self.agree.append(shared)
        self.fresh.append(path[shared + 1 :])
        self.above.append(path[shared])
        self.words.append(words[shared:])
        self.last = seq

    def merged(self) -> tuple[list[int], list]:
        """Compressed nodes from the deepest edges up: the nodes below each, and its other fields."""
        count = len(self.convs)
        depth, low, high = list(self.depths), list(range(count)), list(range(1, count + 1))
        least, ends, below = list(self.convs), [[c] for c in self.convs], [[] for _ in range(count)]
        up, top = list(range(count)), list(range(count))

        def find(at: int) -> int:
            while up[at] != at:
                up[at] = up[up[at]]
                at = up[at]
            return at

        def node(at: int, first: int, end: int, smallest: int, children: list[int]) -> int:
            for column, value in zip((depth, low, high, least, ends, below), (at, first, end, smallest, [], children), strict=True):
                column.append(value)
            return len(depth) - 1

        for at in sorted(range(1, count), key=lambda k: -self.agree[k]):
            level, left, right = self.agree[at], find(at - 1), find(at)
            a, b = top[left], top[right]
            if depth[a] > level:
                a = node(level, low[a], high[b], min(least[a], least[b]), [a, b])
            else:
                if depth[b] > level:
                    below[a].append(b)
                else:  # the same sequence again
                    ends[a] += ends[b]
                high[a], least[a] = high[b], min(least[a], least[b])
            if high[top[left]] - low[top[left]] < high[b] - low[b]:
                left, right = right, left
            up[right], top[left] = left, a
        head = top[find(0)]
        if depth[head]:
            head = node(0, 0, count, least[head], [head])
        return [head], [depth, low, high, least, ends, below]

    def rows(self) -> Iterator[tuple]:
        if not self.convs:
            return
        order, (depth, low, high, least, ends, below) = self.merged()
        count, over = len(self.convs), {order[0]: -1}
        for at in order:  # grows while it is read: parents come before their children
            for child in below[at]:
                over[child] = at
                order.append(child)
        tops: dict[int, tuple[int, int, int]] = {}  # of a chain's highest node: leaves, saved, whether it is counted here
        for x in reversed(order):
            parent = over.pop(x)
            floor = depth[parent] if parent >= 0 else -1
            first, last = low[x] == 0, high[x] == count
            size, row = high[x] - low[x], low[x]
            under = [tops.pop(c) for c in below[x]]
            leaves, saved = sum(t[0] for t in under), sum(t[1] for t in under)
            children, ended = sum(t[2] for t in under), ends[x]
            if not under and not (last and depth[x] <= self.behind):
                leaves += 1
            fresh, words, base = self.fresh[row], self.words[row], self.agree[row]
            for d in range(depth[x], floor, -1):
                counted = not (first and d <= self.before)
                weight = words[d - 1 - base] if d else 0
                saved += (size - counted) * weight
                shared = not counted or (last and d <= self.behind)
                if d == 0:
                    above, above_conv = None, None
                else:
                    above = fresh[d - 2 - base] if d - 1 > base else self.above[row]
                    inside = d - 1 > floor
                    up_first = first if inside else low[parent] == 0
                    up_last = last if inside else high[parent] == count
                    known = not (up_first and d - 1 <= self.before) and not (up_last and d - 1 <= self.behind)
                    above_conv = (least[x] if inside else least[parent]) if known else None
                digest = fresh[d - 1 - base] if d else ROOT
                yield (self.part, shared, digest, above, d, least[x], above_conv, size, children, leaves, saved, ended)
                children, ended = int(counted), None
            tops[x] = (leaves, saved, children)


def forests(dealt: DataFrame, edges: dict[int, tuple[int, int]]) -> DataFrame:
    """The nodes of every range of ``part, seq, conv_id, words``, in order; ``edges`` has each range's two agreements."""

    def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows:
            held.append(row)
            if len(held) == NODES:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (
            row
            for batch in batches
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "conv_id", "words")), strict=True)
        )
        for part, rows in groupby(stream, key=lambda r: r[0]):
            forest = _Forest(part, *edges[part])
            for _, seq, conv, words in rows:
                forest.add(conv, seq, words)
            yield from batches_of(forest.rows())

    return dealt.select("part", "seq", "conv_id", "words").mapInArrow(run, SCHEMA)


def range_edges(ranges: DataFrame) -> dict[int, tuple[int, int]]:
    """For every range, the depth to which its first (last) sequence agrees with its neighbour; -1 at the ends."""

    @F.pandas_udf("long")
    def agreed(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([-1 if a is None or b is None else agreement(a, b) for a, b in zip(one, other, strict=True)], dtype="int64")

    order = Window.orderBy("part")  # one row for each range
    heads = ranges.groupBy("part").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    near = heads.select(
        "part", "first", "last", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("behind")
    )
    rows = near.select("part", agreed("first", "before").alias("before"), agreed("last", "behind").alias("behind"))
    return {r["part"]: (r["before"], r["behind"]) for r in rows.collect()}


def prefix_trie(found: DataFrame, turns_per_range: int = TURNS_PER_RANGE) -> Trie:
    """The trie of all prefixes of the sequences ``conv_id, marks`` (see ``sequences``).

    A node of depth d is a distinct sequence of d first turns; the root has depth
    0. Its members are the conversations that start with it, also those without
    turns. ``n_leaves`` counts childless nodes and ``saved_tokens`` sums
    (members - 1) * words of the last turn, both over the node and all below.
    No conversations give no nodes. The sequences of a range (``turns_per_range``
    turns, or one conversation) are all a task holds, as digests of 16 bytes.
    """
    spark = found.sparkSession
    seqs = settled(
        found.select("conv_id", F.unhex(F.array_join("marks.mark", "")).alias("seq"), F.col("marks.words").alias("words")),
        "sequences",
    )
    turns = seqs.agg(F.sum(F.size("words"))).first()[0] or 0
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // turns_per_range))
    ranges = seqs.repartitionByRange(count, "seq", "conv_id").withColumn("part", F.spark_partition_id())
    ranges = settled(ranges, "ranges")
    edges = range_edges(ranges)
    dealt = ranges.repartitionById(count, F.col("part")).sortWithinPartitions("part", "seq", "conv_id")
    pieces = settled(forests(dealt, edges), "forests")

    shared = pieces.where("shared")
    merged = settled(
        shared.groupBy("node").agg(
            F.min("parent").alias("parent"),
            F.min("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        ),
        "shared",
    )
    heads = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("__conv"))
    spots = shared.select("part", F.col("node").alias("parent")).join(heads, "parent")
    own = pieces.where("not shared").drop("shared", "ends")
    inner = own.where("parent_conv_id is not null or parent is null").drop("part")
    outer = own.where("parent_conv_id is null and parent is not null").drop("parent_conv_id").join(spots, ["part", "parent"])
    columns = [c for c in _NAMES if c not in ("part", "shared", "ends")]
    nodes = inner.select(*columns)
    nodes = nodes.unionByName(outer.withColumnRenamed("__conv", "parent_conv_id").select(*columns))
    nodes = nodes.unionByName(merged.join(heads, "parent", "left").withColumnRenamed("__conv", "parent_conv_id").select(*columns))
    return Trie(nodes, pieces.where("size(ends) > 0").select("node", "part", F.col("ends").alias("conv_ids")))


def ends_digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: SHA-256 of the ids that end in a node, ascending and joined by commas.

    The lists of a node pass through one task one after the other; it holds one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        out: tuple[list, list] = ([], [])
        for batch in batches:
            for at in range(batch.num_rows):
                node, ids = batch.column(0)[at].as_py(), batch.column(2)[at].as_py()
                joined = ",".join(map(str, ids)).encode()
                if node == now:
                    digest.update(b"," + joined)
                    continue
                if now is not None:
                    out[0].append(now)
                    out[1].append(digest.hexdigest())
                now, digest = node, hashlib.sha256(joined)
            if len(out[0]) >= NODES:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["node", "ends_sha256"])
                out = ([], [])
        if now is not None:
            out[0].append(now)
            out[1].append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["node", "ends_sha256"])

    dealt = ends.repartition(F.col("node")).sortWithinPartitions("node", "part")
    return dealt.select("node", "part", "conv_ids").mapInArrow(run, "node binary, ends_sha256 string")


def node_digests(trie: Trie) -> DataFrame:
    """The nodes of a trie with ``ends_sha256`` (of the empty string where no conversation ends)."""
    none = F.lit(hashlib.sha256(b"").hexdigest())
    rows = trie.nodes.join(ends_digests(trie.ends), "node", "left")
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
