"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the least of its inner s-mers stands at
its start or its end. Whether it is one depends on nothing outside the k-mer, so
an edit changes only the anchors that touch it. A fingerprint keeps every distinct
anchor with its first position, whatever the length of the text.

Likeness of two fingerprints: anchors are matched by hash, and the longest chain
of matches that follow each other in both texts counts, so a block put in or taken
out anywhere breaks nothing behind it. The result is the number of chained
matches over the larger number of anchors.

Defined results: a NULL text counts as empty; an empty text has the fingerprint
``0:0:``; a text shorter than a k-mer, or without an anchor, has one anchor made of
the whole text; two empty texts are alike (1), an empty and another one are not
(0); equal texts have equal fingerprints; no part of a text is left out.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodline.llm.arrays import U64, code_points, mix, slices

#: Code points of a k-mer and of its inner s-mers.
K, S = 12, 5
#: Rows of one range of ids, roughly; further ranges are made beyond the session's partitions.
ROWS_PER_RANGE = 50_000


def anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hash and position of every closed syncmer."""
    count = len(points) - K + 1
    if count <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    small = np.zeros(len(points) - S + 1, U64)
    for step in range(S):
        small = small * U64(0x9E3779B97F4A7C15) + points[step : step + len(small)]
    ranks = (mix(small) >> U64(32)).astype(np.uint32)
    inner = K - S + 1
    least, width = ranks, 1
    while 2 * width <= inner:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < inner:
        least = np.minimum(least[: -(inner - width)], least[inner - width :])
    at = np.flatnonzero((least == ranks[:count]) | (least == ranks[K - S : K - S + count]))
    hashes = mix(mix(small[at]) * U64(3) + mix(small[at + S]) * U64(5) + small[at + K - S])
    return (hashes >> U64(32)).astype(np.uint32), at


def sketch(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and first positions of all anchors, by hash."""
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    hashes, at = anchors(points)
    if not len(hashes):
        whole = hashlib.blake2b(points.astype("<u4").tobytes(), digest_size=4).digest()
        return np.frombuffer(whole, "<u4"), np.zeros(1, np.int64)
    hashes, first = np.unique(hashes, return_index=True)
    return hashes, at[first]


def to_text(hashes: np.ndarray, at: np.ndarray) -> str:
    """``0:``, the number of anchors, and in base 64 their hashes by position and the steps between positions.

    A step takes seven bits of each byte, the last byte has its high bit set. No share
    of the hashes is left out (0 halvings).
    """
    order = np.argsort(at, kind="stable")
    steps = np.diff(at[order], prepend=0).astype(np.uint64)
    sizes = np.maximum(1, np.ceil(np.log2(steps + 1.0) / 7)).astype(np.int64)
    ends = np.cumsum(sizes)
    coded = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for byte in range(int(sizes.max()) if len(sizes) else 0):
        has = sizes > byte
        coded[ends[has] - sizes[has] + byte] = (steps[has] >> np.uint64(7 * byte)) & np.uint64(127)
    coded[ends - 1] |= 128
    body = hashes[order].astype("<u4").tobytes() + coded.tobytes()
    return f"0:{len(at)}:{base64.b64encode(body).decode()}"


def from_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    _, count, body = text.split(":")
    data = base64.b64decode(body)
    hashes = np.frombuffer(data, "<u4", int(count))
    coded = np.frombuffer(data, np.uint8, offset=4 * int(count))
    ends = np.flatnonzero(coded & 128) + 1
    starts = np.concatenate(([0], ends))[:-1].astype(np.int64)
    places = np.arange(len(coded)) - np.repeat(starts, ends - starts)
    parts = (coded & 127).astype(np.int64) << (7 * places)
    at = np.cumsum(np.add.reduceat(parts, starts)) if len(ends) else np.zeros(0, np.int64)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], at[order]


def chained(places: np.ndarray) -> int:
    """Length of the longest increasing subsequence of distinct places."""
    if (places[1:] > places[:-1]).all():
        return len(places)
    ends: list[int] = []
    for place in places.tolist():
        if not ends or place > ends[-1]:
            ends.append(place)
        else:
            ends[bisect_left(ends, place)] = place
    return len(ends)


def likeness(one: tuple, other: tuple) -> float:
    """Share of anchors (0 to 1) that match in hash and follow each other in both texts."""
    (a, at_a), (b, at_b) = one, other
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, rows_a, rows_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(rows_a):
        return 0.0
    return chained(at_b[rows_b][np.argsort(at_a[rows_a])]) / max(len(a), len(b))


def edited(own: str, following: str) -> str:
    """The last half of ``own`` replaced by as much of the start of ``following``."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


def dealt_in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``part, extra, doc, text``: rows dealt by ranges of ids and sorted, each range with its successor.

    Every range ends with a copy (``extra``) of the first row of the next range,
    the last one with the very first row. Only ids and the first id of each range
    are looked at beforehand; texts are shuffled once. Equal ids follow by a hash
    of the text; NULL ids come first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("ord", F.coalesce("doc", F.lit(-(2**63)))).withColumn("tie", F.xxhash64("text"))
    ids = rows.select("ord")
    count = ids.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // ROWS_PER_RANGE))
    asked = [k / parts for k in range(1, parts)] or [0.5]
    found = ids.agg(F.percentile_approx("ord", asked, 20 * parts)).first()[0]
    bounds = np.array(sorted(set(found or [])), np.int64)

    @F.pandas_udf("int")
    def part_of(ord_: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ord_.to_numpy()).astype(np.int32))

    dealt = rows.withColumn("part", part_of("ord"))
    heads = dealt.groupBy("part").agg(F.min(F.struct("ord", "tie")).alias("head")).collect()
    heads = sorted((r["part"], r["head"]["ord"], r["head"]["tie"]) for r in heads)
    before = {(o, t): heads[k - 1][0] for k, (_, o, t) in enumerate(heads)}

    @F.pandas_udf("int")
    def copied_to(ord_: pd.Series, tie: pd.Series) -> pd.Series:
        pairs = zip(ord_.tolist(), tie.tolist(), strict=True)
        return pd.Series([before.get(pair, -1) for pair in pairs], dtype="int32")

    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("extra"))
    copy = F.struct(F.col("copy").alias("part"), F.lit(1).alias("extra"))
    places = F.when(F.col("copy") >= 0, F.array(own, copy)).otherwise(F.array(own))
    placed = dealt.withColumn("copy", copied_to("ord", "tie")).select(
        F.inline(places), "doc", "text", "ord", "tie"
    )
    # By number and not by hash, so that no two ranges meet in one task.
    return placed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "extra", "ord", "tie")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with two likenesses.

    The edited form has the last half of the code points replaced by the start of
    the next text in the order of ids (after the last one, the first).
    """
    schema = (
        f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor
        for batch in batches:
            for part in slices(batch):
                columns = (part.column(c).to_pylist() for c in ("part", "extra", "doc", "text"))
                out = []
                for number, extra, doc, own in zip(*columns, strict=True):
                    if extra and (held is None or held[0] != number):
                        continue  # a further copy of equal heads
                    mark = sketch(code_points([own])[0])
                    if held is not None:
                        _, before, before_text, before_mark = held
                        changed = edited(before_text, own)
                        changed_mark = sketch(code_points([changed])[0])
                        out.append(
                            (
                                before,
                                len(before_text),
                                hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                                to_text(*before_mark),
                                to_text(*changed_mark),
                                likeness(before_mark, changed_mark),
                                likeness(before_mark, mark),
                            )
                        )
                    held = None if extra else (number, doc, own, mark)
                if out:
                    arrays = [pa.array(list(c)) for c in zip(*out, strict=True)]
                    arrays[0] = arrays[0].cast(pa.int64())
                    yield pa.RecordBatch.from_arrays(arrays, names)

    dealt = dealt_in_order(docs, key, text)
    return dealt.select("part", "extra", "doc", "text").mapInArrow(run, schema)
