"""Best-fit packing of token sequences by length patterns.

Texts become pieces of at most ``LIMIT`` tokens. Only the histogram of piece
lengths, never the pieces, reaches the driver: patterns of a few lengths are
enumerated, their repeat counts fitted to the histogram by non-negative least
squares and rounded down, and what is left is packed best-fit, length by length.
The plan says which stretch of the pieces of a length goes to which sequences;
every piece finds its place from its rank among the pieces of its length.

Defined results: a NULL text is empty and consists of the closing id alone;
repeated rows are packed each; a NULL id is kept; ranks follow id and piece, and
rows that agree in both are told apart by content; no rows give no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broodline.llm.arrays import per_batch
from broodline.llm.graph import settled
from broodline.llm.tokenizing import encoder

LIMIT = 2048
#: The id that closes a document.
CLOSING = 0
#: Rows ranked by one task at once, on average.
RANKED = 4000


def pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` of every piece of every document.

    A document longer than ``limit`` is cut into pieces of ``limit`` tokens with
    the shorter piece first.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, begins = encoder(tokenizer).encode(batch.column(1))
        closing = np.array([CLOSING], "<u4").tobytes()
        rows, number, start, length, crc = [], [], [], [], []
        for row in range(batch.num_rows):
            data = ids[begins[row] : begins[row + 1]].tobytes() + closing
            total = len(data) // 4
            at = 0
            k = 0
            while at < total:
                size = min(limit, total) if at else (total - 1) % limit + 1
                rows.append(row)
                number.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                at += size
                k += 1
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(number, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ],
            [key, "piece", "start", "length", "ids_crc32"],
        )

    chosen = docs.select(key, F.col(text).alias("__text"))
    schema = docs.select(key).schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        schema = schema.add(name, kind)
    return per_batch(chosen, work, schema)


def enumerate_patterns(lengths: list[int], counts: dict[int, int], limit: int) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths, descending, that fill ``limit`` exactly or nearly.

    For each length the best partners among the ``near`` most frequent and most
    similar lengths are tried, so the number grows with the lengths and not with
    their combinations.
    """
    present = np.array(sorted(lengths))
    out = {(length,) for length in lengths}
    frequent = sorted(lengths, key=lambda x: (-counts[x], x))[:24]

    def largest(room: int) -> int:
        spot = int(np.searchsorted(present, room, "right")) - 1
        return int(present[spot]) if spot >= 0 else 0

    for first in lengths:
        room = limit - first
        if (second := largest(room)) > 0:
            out.add(tuple(sorted((first, second), reverse=True)))
        for second in [*frequent, largest(room // 2)]:
            left = room - second
            if second <= 0 or left <= 0:
                continue
            if (third := largest(left)) > 0:
                out.add(tuple(sorted((first, second, third), reverse=True)))
            half = largest(left // 2)
            if half > 0 and (fourth := largest(left - half)) > 0:
                out.add(tuple(sorted((first, second, half, fourth), reverse=True)))
    return sorted(out)


def fit_repeats(
    patterns: list[tuple[int, ...]], counts: dict[int, int], limit: int, sweeps: int = 40
) -> np.ndarray:
    """Non-negative repeat counts whose lengths come closest to the histogram.

    Coordinate descent on the least squares; lengths weigh as they fill a
    sequence, and patterns with gaps are held back by the tokens they waste.
    """
    need = np.zeros(limit + 1)
    for length, count in counts.items():
        need[length] = count
    weight = np.arange(limit + 1) / limit
    uses = []
    for pattern in patterns:
        parts, times = np.unique(pattern, return_counts=True)
        uses.append((parts, times, weight[parts] * times))
    curve = [float((w * times).sum()) for _, times, w in uses]
    waste = [0.05 * (limit - sum(p)) for p in patterns]
    left = need.copy()
    x = np.zeros(len(patterns))
    for _ in range(sweeps):
        moved = 0.0
        for k, (parts, times, w) in enumerate(uses):
            step = ((w * left[parts]).sum() - waste[k]) / curve[k]
            new = max(0.0, x[k] + step)
            if new != x[k]:
                left[parts] -= times * (new - x[k])
                moved += abs(new - x[k])
                x[k] = new
        if moved < 1e-3 * max(need.sum(), 1):
            break
    return x


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences); places every piece exactly once."""
    left = {length: count for length, count in counts.items() if count > 0}
    done: dict[tuple[int, ...], int] = defaultdict(int)
    if left.get(limit):
        done[(limit,)] = left.pop(limit)
    patterns = enumerate_patterns(sorted(left), left, limit) if left else []
    fitted = fit_repeats(patterns, left, limit) if patterns else []
    by_fill = sorted(zip(patterns, fitted, strict=True), key=lambda p: (-sum(p[0]), p[0]))
    open_bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for pattern, repeats in by_fill:
        own = defaultdict(int)
        for length in pattern:
            own[length] += 1
        count = min([int(repeats), *(left[length] // n for length, n in own.items())])
        if count > 0 and sum(pattern) >= limit - 2:
            for length, n in own.items():
                left[length] -= n * count
            open_bins[limit - sum(pattern)][pattern] += count
    for length in sorted(left, reverse=True):
        room = length
        while left[length] and room <= limit:
            bins = open_bins.get(room)
            if not bins:
                room += 1
                continue
            pattern, count = next(iter(bins.items()))
            used = min(count, left[length])
            if used == count:
                del bins[pattern]
            else:
                bins[pattern] -= used
            open_bins[room - length][(*pattern, length)] += used
            left[length] -= used
        if left[length]:
            per = limit // length
            full, rest = divmod(left[length], per)
            if full:
                open_bins[limit - per * length][(length,) * per] += full
            if rest:
                open_bins[limit - rest * length][(length,) * rest] += 1
            left[length] = 0
    for bins in open_bins.values():
        for pattern, count in bins.items():
            done[pattern] += count
    return sorted(done.items())


def slots(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: rank bounds, first sequence and offset of its stretches."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, count in packed:
        offset = 0
        for length in pattern:
            out[length].append((ranks[length], base, offset))
            ranks[length] += count
            offset += length
        base += count
    return {k: tuple(np.array(v, np.int64).T) for k, v in out.items()}


def ranked(parts: DataFrame, key: str, total: int) -> DataFrame:
    """Pieces with their rank (from 0) among those of their length.

    Lengths are cut into buckets by a hash, ranked within a bucket and lifted by
    the counts of the buckets before, so a length that most pieces have does not
    meet in one task.
    """
    cut = F.pmod(F.xxhash64(key, "piece"), F.lit(max(1, total // RANKED))).cast("int")
    parts = parts.withColumn("__cut", cut)
    sizes = parts.groupBy("length", "__cut").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    lifted = sizes.select("length", "__cut", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__up"))
    order = Window.partitionBy("length", "__cut").orderBy(key, "piece", "start", "ids_crc32")
    own = parts.withColumn("__own", F.row_number().over(order) - 1)
    joined = own.join(lifted, ["length", "__cut"])
    return joined.withColumn("rank", F.col("__own") + F.col("__up")).drop("__own", "__up", "__cut")


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; sequences hold at most ``limit`` tokens."""
    parts = settled(pieces(docs, tokenizer, key, text, limit), "pieces")
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.count(F.lit(1))).collect()}
    where = slots(plan(counts, limit))
    fields = [key, "piece", "start", "length", "ids_crc32"]
    schema = parts.select(*fields).schema.add("sequence_id", "long").add("offset", "long")

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = batch.column("length").to_numpy()
        ranks = batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            begins, bases, offsets = where[int(length)]
            spot = np.searchsorted(begins, ranks[rows], "right") - 1
            sequence[rows] = bases[spot] + ranks[rows] - begins[spot]
            offset[rows] = offsets[spot]
        columns = [batch.column(f) for f in fields]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(sequence), pa.array(offset)], [*fields, "sequence_id", "offset"]
        )

    return per_batch(ranked(parts, key, sum(counts.values())).select(*fields, "rank"), place, schema)
