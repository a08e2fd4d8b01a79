"""Periodic runs of words, found from minimizers of many scales.

A run is a maximal stretch of words that repeats with its smallest period at
least twice. Periods below ``SHORT`` come from direct lag scans. A longer period
q is sought at the scale P with P <= q < 2P: the least P/4-word grams of all
windows of P words are taken, and two equal ones at a distance between P and 2P
seed an extension by direct comparison. In a run the first window and the one a
period later hold the same words, so their least grams lie a period apart and no
run is missed.

Grams that repeat within half their length would give seeds in every position;
they are never chosen. Where a window holds nothing else, it lies inside a run of
short period, and a long run that starts so has to straddle two touching runs of
one short period; those periods follow from the phases of the two.

Words are compared by 64-bit hashes. Work and memory are in proportion to the
words times the logarithm of the longest text, whatever the texts repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broodline.llm.arrays import PLAIN_WORDS, U64, mix, per_batch, powers, tokens, utf8

#: Words that every run has at least.
LEAST = 12
#: Periods below this are found by scanning each lag; the grams of the first scale have a quarter of it.
SHORT = 48

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_BASE = 0xD1342543DE82EF95
_NEVER = U64(0xFFFFFFFF)
_LOW = U64(32)


class _Runs:
    """Runs found so far: starts, ends and periods; of equal stretches the smallest period counts."""

    def __init__(self) -> None:
        self.found = np.zeros((3, 0), np.int64)

    def add(self, starts, ends, periods) -> None:
        new = np.array([starts, ends, periods], np.int64).reshape(3, -1)
        if new.shape[1]:
            all_ = np.concatenate((self.found, new), axis=1)
            all_ = all_[:, np.lexsort((all_[2], all_[1], all_[0]))]
            first = np.ones(all_.shape[1], bool)
            first[1:] = (all_[:2, 1:] != all_[:2, :-1]).any(axis=0)
            self.found = all_[:, first]


def stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of consecutive numbers in a rising array."""
    cuts = np.flatnonzero(np.diff(places) != 1) + 1
    return places[np.concatenate(([0], cuts))], places[np.concatenate((cuts - 1, [len(places) - 1]))] + 1


def scan_lags(ids: np.ndarray, runs: _Runs, short: int, least: int) -> None:
    out = []
    for lag in range(1, min(short, len(ids))):
        places = np.flatnonzero(ids[lag:] == ids[:-lag])
        if len(places):
            starts, ends = stretches(places)
            long = ends - starts >= max(lag, least - lag)
            out.append((starts[long], ends[long] + lag, np.full(int(long.sum()), lag)))
    if out:
        runs.add(*(np.concatenate(c) for c in zip(*out, strict=True)))


def extended(ids: np.ndarray, low: int, high: int, lag: int) -> tuple[int, int]:
    """The whole stretch of equal words ``lag`` apart around the places from ``low`` to ``high``."""
    step = 64
    while high + lag < len(ids):
        stop = min(high + step, len(ids) - lag)
        differs = ids[high:stop] != ids[high + lag : stop + lag]
        at = int(differs.argmax())
        if differs[at]:
            high += at
            break
        high, step = stop, 2 * step
    step = 64
    while low > 0:
        start = max(low - step, 0)
        differs = (ids[start:low] != ids[start + lag : low + lag])[::-1]
        at = int(differs.argmax())
        if differs[at]:
            low -= at
            break
        low, step = start, 2 * step
    return low, high


def least_grams(hashes: np.ndarray, unfit: np.ndarray, windows: int) -> np.ndarray:
    """Places of the least fit gram (leftmost of equal ones) of every ``windows`` consecutive grams."""
    keys = np.where(unfit, _NEVER, np.minimum(hashes >> _LOW, _NEVER - U64(1))) << _LOW
    keys |= np.arange(len(keys), dtype=U64)
    width = 1
    while 2 * width <= windows:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    rest = windows - width
    if rest:
        keys = np.minimum(keys[:-rest], keys[rest:])
    chosen = (keys & _NEVER).astype(np.int64)[keys >> _LOW != _NEVER]
    return chosen[np.concatenate(([True], np.diff(chosen) > 0))] if len(chosen) else chosen


def seeds(hashes: np.ndarray, places: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of equal chosen grams between ``scale`` and twice as far apart."""
    values = hashes[places]
    order = np.argsort(values, kind="stable")
    places, values = places[order], values[order]
    out = [np.zeros((2, 0), np.int64)]
    for step in range(1, len(places)):
        apart = places[step:] - places[:-step]
        near = (values[step:] == values[:-step]) & (apart < 2 * scale)
        if not near.any():
            break
        near &= apart >= scale
        out.append(np.array([places[:-step][near], apart[near]]))
    pairs = np.concatenate(out, axis=1)
    return tuple(pairs[:, np.lexsort((pairs[0], pairs[1]))])


def straddling(ids: np.ndarray, runs: np.ndarray, scale: int) -> list[tuple[int, int, int]]:
    """Runs of periods from ``scale`` to twice that across two touching runs of one short period."""
    out = []
    starts, ends, periods = runs[:, np.lexsort((runs[0], runs[2]))]
    touch = (periods[1:] == periods[:-1]) & (starts[1:] <= ends[:-1]) & (8 * periods[1:] <= scale)
    for k in np.flatnonzero(touch):
        low, high, start, end, period = (int(v) for v in (starts[k], ends[k], starts[k + 1], ends[k + 1], periods[k]))
        most = min(2 * scale - 1, high - low, end - start, (end - low) // 2)
        if most < scale:
            continue
        head = ids[start : start + period]
        turns = np.flatnonzero(ids[low : low + period] == head[0]) + low
        phase = next((at for at in turns.tolist() if (ids[at : at + period] == head).all()), None)
        if phase is None:
            continue
        lags = np.arange(scale + (start - phase - scale) % period, most + 1, period)
        first, last = np.maximum(low, start - lags), np.minimum(high, end - lags)
        fits = last - first >= lags
        for lag, a, b in zip(lags[fits].tolist(), first[fits].tolist(), last[fits].tolist(), strict=True):
            if low == start - lag or high == end - lag:
                a, b = extended(ids, a, b, lag)
            out.append((a, b + lag, lag))
    return out


def find_runs(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST, short: int = SHORT) -> np.ndarray:
    """Starts, ends and periods of all runs of the texts in ``ids``.

    The texts follow each other from the longest to the shortest (``sizes``
    words), each closed by a number of its own, so no run crosses a text.
    ``short`` is a multiple of 4 and at least 4 times ``least``.
    """
    runs = _Runs()
    scan_lags(ids, runs, short, least)
    if len(sizes) == 0 or sizes[0] < 2 * short:
        return runs.found
    closes = np.cumsum(sizes + 1)
    count = int(closes[np.searchsorted(-sizes, -2 * short, side="right") - 1])
    up, down = powers(count, _BASE), powers(count, pow(_BASE, -1, 1 << 64))
    sums = np.zeros(count + 1, U64)
    np.cumsum(mix(ids[:count].astype(U64) + U64(1)) * up, dtype=U64, out=sums[1:])
    scale = short
    while 2 * scale <= sizes[0]:
        count = int(closes[np.searchsorted(-sizes, -2 * scale, side="right") - 1])
        part, gram = ids[:count], scale // 4
        grams = count - gram + 1
        hashes = mix((sums[gram : count + 1] - sums[:grams]) * down[:grams])
        known = runs.found[:, runs.found[1] <= count]
        starts, ends, _ = known[:, (2 * known[2] <= gram) & (known[1] - known[0] >= gram)]
        marks = np.zeros(grams + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, ends - gram + 1, -1)
        places = least_grams(hashes, np.cumsum(marks[:-1]) > 0, scale - gram + 1)
        new, reached, lag_before = [], 0, 0
        for at, lag in zip(*(c.tolist() for c in seeds(hashes, places, scale)), strict=True):
            if lag == lag_before and at < reached:
                continue
            low, high = extended(part, at, at, lag)
            reached, lag_before = high, lag
            if high - low >= lag:
                new.append((low, high + lag, lag))
        new += straddling(part, known, scale)
        if new:
            runs.add(*zip(*new, strict=True))
        scale *= 2
    return runs.found


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words, each followed by a space, and the place behind each."""
    if not len(starts):
        return b"", np.zeros(0, np.int64)
    sizes = ends - starts + 1
    closes = np.cumsum(sizes)
    padded = np.append(data, np.uint8(0x20))
    out = padded[np.repeat(starts - closes + sizes, sizes) + np.arange(closes[-1])]
    out[closes - 1] = 0x20
    return out.tobytes(), closes


def runs_of_texts(column: pa.Array, least: int) -> tuple[list[int], list[list[dict]], list[bytes]]:
    """Words, runs by start and period, and the text without repeats, of every row."""
    data, offsets = utf8(column)
    starts, ends, hashes = tokens(data, offsets, PLAIN_WORDS)
    rows = len(offsets) - 1
    first = np.searchsorted(starts, offsets)
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    by_size = sizes[order]
    opens = np.cumsum(by_size + 1) - by_size - 1
    values, numbers = np.unique(hashes, return_inverse=True)
    total = int(sizes.sum())
    words = np.repeat(first[:-1][order] - np.cumsum(by_size) + by_size, by_size) + np.arange(total)
    slots = np.arange(total) + np.repeat(np.arange(rows), by_size)
    ids = np.zeros(total + rows, np.int32)
    ids[slots] = numbers[words]
    ids[opens + by_size] = len(values) + np.arange(rows)
    found = find_runs(ids, by_size, least)
    found = found[:, np.lexsort((found[2], found[0]))]

    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, found[0] + found[2], 1)
    np.add.at(marks, found[1], -1)
    kept = np.cumsum(marks)[slots] == 0
    text, closes = joined_words(data, starts[words[kept]], ends[words[kept]])
    bounds = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], np.cumsum(by_size)))]
    closes = np.concatenate(([0], closes))
    owner = np.searchsorted(opens, found[0], side="right") - 1
    run_bounds = np.searchsorted(owner, np.arange(rows + 1))

    runs, texts = [[] for _ in range(rows)], [b""] * rows
    for place, row in enumerate(order.tolist()):
        a, b = int(closes[bounds[place]]), int(closes[bounds[place + 1]])
        texts[row] = text[a : max(a, b - 1)]
        here = found[:, run_bounds[place] : run_bounds[place + 1]]
        runs[row] = [
            {"start": s - int(opens[place]), "length": e - s, "period": q}
            for s, e, q in zip(*(c.tolist() for c in here), strict=True)
        ]
    return sizes.tolist(), runs, texts


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``key, n_words, runs, collapsed``: the runs of every whole text, and the text without their repeats.

    Words are stretches without ASCII white space, numbered from 0. ``runs`` has
    ``start, length, period`` of every maximal stretch of at least ``least`` words
    that holds its smallest period twice, by start and period. ``collapsed``
    leaves out each word behind the first period of a run that contains it and
    joins the others by one space. NULL and empty texts have no words; rows are
    never merged, NULL keys stay, other columns are left out. One pass without a
    shuffle.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, runs, texts = runs_of_texts(batch.column(1), least)
        struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        arrays = [
            batch.column(0),
            pa.array(sizes, pa.int64()),
            pa.array(runs, pa.list_(struct)),
            pa.array(texts, pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(arrays, [key, "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    return per_batch(rows, work, f"`{key}` {kind}, n_words long, runs {RUNS}, collapsed string")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def with_made_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text``: about every tenth text gets a periodic end, decided by a hash of its id.

    With h the CRC-32 of the decimal id and g = h / 10: where h % 10 is 0, each
    word from a = g % n on becomes word a + (i - a) % p with
    p = 1 + (n - a) / (3 + g % 8), words joined by one space. Other texts, and
    those of NULL ids, stay as they are.
    """
    mark = F.crc32(F.col(key).cast("string"))
    parts = docs.select(F.col(key), F.col(text).alias("__text"), mark.alias("__h"))
    parts = parts.withColumn("__words", F.when(F.col("__h") % 10 == 0, words_of(F.col("__text"))))
    share = F.expr("__h div 10")
    parts = parts.withColumn("__n", F.size("__words").cast("long"))
    parts = parts.withColumn("__a", F.when(F.col("__n") > 0, share % F.col("__n")))
    parts = parts.withColumn("__p", F.expr("1 + (__n - __a) div (3 + (__h div 10) % 8)"))
    made = F.expr(
        "array_join(transform(sequence(0L, __n - 1), "
        "i -> __words[cast(if(i < __a, i, __a + (i - __a) % __p) as int)]), ' ')"
    )
    return parts.select(key, F.when(F.col("__a").isNotNull(), made).otherwise(F.col("__text")).alias(text))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of the result of ``periodic_runs``: the longest run and two hashes."""
    ranked = F.expr(
        "array_min(transform(runs, r -> struct(-r.length as l, r.start as start, r.period as period)))"
    )
    listed = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period)), '\\n')")
    longest = found.withColumn("__top", ranked)
    length = -F.col("__top.l")
    return longest.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("__top.start").alias("start"),
        length.alias("length"),
        F.col("__top.period").alias("period"),
        F.expr("(-1000 * __top.l) div __top.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
