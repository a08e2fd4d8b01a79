"""Array views of Arrow text columns, shared by the operators of this package.

All helpers work on one Arrow batch inside a task. Texts are joined to one
array with document offsets, so that hashing and counting run in numpy over a
whole batch instead of word by word. NULL texts read as empty ones.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes or code points handled at once; bounds the working arrays of a task.
BLOCK = 1 << 20

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    values = values ^ (values >> U64(32))
    values = values * U64(0xD6E8FEB86659FD93)
    values = values ^ (values >> U64(29))
    values = values * U64(0xA0761D6478BD642F)
    return values ^ (values >> U64(32))


def powers(count: int, base: int) -> np.ndarray:
    out = np.full(count, base, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=U64)


_UP = powers(1, _ODD)
_DOWN = powers(1, _ODD_INVERSE)


def _tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < count:
        _UP, _DOWN = powers(count, _ODD), powers(count, _ODD_INVERSE)
    return _UP, _DOWN


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows (one more than rows)."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if len(column) else pa.array([], pa.large_string())
    _, ends, data = column.buffers()
    offsets = np.zeros(1, np.int64)
    if len(column):
        offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts joined, and the offsets of the texts."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return np.frombuffer(joined, "<u4"), np.concatenate(([0], np.cumsum(lengths)))


#: Byte classes: 0 separates, 1 belongs to a word, 2 is punctuation.
PLAIN_WORDS = np.ones(256, np.uint8)
PLAIN_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
WORDS_AND_MARKS = np.full(256, 2, np.uint8)
WORDS_AND_MARKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
for _range in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORDS_AND_MARKS[_range[0] : _range[1]] = 1
ALPHANUMERIC = np.where(WORDS_AND_MARKS == 1, 1, 0).astype(np.uint8)

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[0x41:0x5B] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _ASCII_LOWER[data]


def span_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial of the bytes mixed with their number."""
    up, down = _tables(len(part) + 1)
    sums = np.zeros(len(part) + 1, U64)
    np.cumsum((part + U64(1)) * up[: len(part)], dtype=U64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def tokens(
    data: np.ndarray, offsets: np.ndarray, classes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every maximal run of one non-zero byte class.

    Runs end where a row ends. Hashes are read off prefix sums; long inputs are cut
    at separators, so the working arrays stay small however long a text is.
    """
    row_start = np.zeros(len(data) + 1, bool)
    row_start[offsets] = True
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        if stop < len(data):
            separators = np.flatnonzero(classes[data[at:stop]] == 0)
            if len(separators) and separators[-1] > 0:
                stop = at + int(separators[-1])
            else:
                while stop < len(data) and classes[data[stop]] and not row_start[stop]:
                    stop += 1
        part = data[at:stop]
        kind = classes[part]
        before = np.concatenate(([0], kind[:-1]))
        opens = (kind > 0) & ((kind != before) | row_start[at:stop])
        after = np.concatenate((kind[1:], [0]))
        closes = (kind > 0) & ((kind != after) | row_start[at + 1 : stop + 1])
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        if len(s):
            hashes.append(span_hashes(part, s, e))
            starts.append(s + at)
            ends.append(e + at)
        at = stop
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def per_batch(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str
) -> DataFrame:
    """Apply ``work`` to slices of about ``BLOCK`` text bytes of every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield work(part)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch holding about ``BLOCK`` bytes each, a row at least."""
    if not batch.num_rows:
        return
    rows = max(1, int(batch.num_rows * BLOCK / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, for what is costly to load again."""
    module = sys.modules.setdefault("_broodline_worker", types.ModuleType("_broodline_worker"))
    return module.__dict__


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """True for rows whose crc32 of the id as text leaves ``part`` when divided by ``parts``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def hash_share(column: str, share: Column) -> Column:
    """A repeatable choice of about ``share`` of the rows by a hash of ``column``."""
    return F.pmod(F.xxhash64(F.col(column), F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000
