"""Quality rules: counts of each text, and a hashed n-gram likelihood ratio of trusted texts to all texts.

Words and word pairs of all documents are counted in cells, once for the whole
corpus and once for its trusted documents. The weight of a cell is the logarithm
of its share among trusted n-grams over its share among all, one added to every
count. A document's score is the mean weight of its n-grams. Weights are whole
numbers (millionths), so sums do not depend on the order of rows and a document
always gets the same verdict.

The number of cells grows with the root of the corpus, so the counts grow with it
too, and the weights that every task holds stay far smaller than the input: 4 times
the root of the text bytes, rounded up to a power of two, 4 bytes each (1 MB for a
gigabyte, 256 MB for 100 TB).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broodline.llm.arrays import PLAIN_WORDS, U64, mix, per_batch, slices, tokens, utf8
from broodline.llm.graph import settled

#: Cells for each root of a text byte, and the fewest there are.
CELLS_PER_ROOT = 4
FEWEST_CELLS = 1 << 12
#: Weights are whole multiples of one over this.
UNIT = 1_000_000
#: Share of the trusted calibration documents that may fall below the threshold, and of the others above it.
TAIL = 0.005
#: Trusted ids up to this many (16 bytes each) go to every task; beyond, the join is left to Spark.
IDS_SENT = 4_000_000
#: Cells in a row of the weight table.
ROW = 4096

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PAIR = U64(0xA24BAED4963EE407)
_CELL = U64(0x9FB21C651E98DF25)


def document_words(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, hashes and documents of all words, and each document's first word."""
    starts, ends, hashes = tokens(data, offsets, PLAIN_WORDS)
    first = np.searchsorted(starts, offsets)
    return starts, ends, hashes, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


def gram_cells(hashes: np.ndarray, docs: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the words and of the pairs of neighbours in one document, with their documents."""
    shift = U64(64 - cells.bit_length() + 1)
    inner = docs[1:] == docs[:-1]
    pairs = mix(hashes[:-1] * _PAIR + hashes[1:])[inner]
    grams = np.concatenate((mix(hashes ^ _CELL), pairs))
    return (grams >> shift).astype(np.int64), np.concatenate((docs, docs[:-1][inner]))


def per_document(values: np.ndarray, docs: np.ndarray, rows: int) -> np.ndarray:
    """Sums of whole numbers by document."""
    out = np.zeros(rows, np.int64)
    np.add.at(out, docs, values)
    return out


def repeated(groups: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (group, hash) occur twice or more, and which are no first occurrence."""
    order = np.lexsort((hashes, groups))
    g, h = groups[order], hashes[order]
    again = np.zeros(len(g), bool)
    again[1:] = (g[1:] == g[:-1]) & (h[1:] == h[:-1])
    several = again.copy()
    several[:-1] |= again[1:]
    both = np.zeros((2, len(g)), bool)
    both[0, order], both[1, order] = several, again
    return both[0], both[1]


def line_classes() -> np.ndarray:
    """Everything but the line feed is part of a line."""
    classes = np.ones(256, np.uint8)
    classes[0x0A] = 0
    return classes


_LINES = line_classes()


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of every document."""
    rows = len(offsets) - 1
    starts, ends, hashes, docs, first = document_words(data, offsets)
    n_words = np.diff(first)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))

    line_starts, line_ends, line_hashes = tokens(data, offsets, _LINES)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_docs = np.searchsorted(offsets, line_starts, side="right")[worded] - 1
    _, again = repeated(line_docs, line_hashes[worded])

    inner = docs[2:] == docs[:-2] if len(docs) > 2 else np.zeros(0, bool)
    at = np.flatnonzero(inner)
    windows = mix(mix(hashes[at] * _PAIR + hashes[at + 1]) * _PAIR + hashes[at + 2])
    several, _ = repeated(docs[at], windows)
    covered = np.zeros(len(docs) + 2, bool)
    for step in range(3):
        covered[at[several] + step] = True
    return {
        "n_words": n_words,
        "word_chars": per_document(heads[ends] - heads[starts], docs, rows),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(line_docs[again], minlength=rows),
        "n_repeat_words": np.bincount(docs[covered[: len(docs)]], minlength=rows),
    }


@dataclass
class RatioModel:
    """Cell weights (in units of 1 / ``UNIT``) and the least mean weight of a document that stays."""

    weights: np.ndarray
    threshold: int | None = None


def cells_for(text_bytes: int) -> int:
    """The least power of two of at least ``CELLS_PER_ROOT`` times the root of the text bytes."""
    wanted = max(FEWEST_CELLS, int(CELLS_PER_ROOT * max(text_bytes, 0) ** 0.5))
    return 1 << (wanted - 1).bit_length()


def with_trust(docs: DataFrame, key: str, trust: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``trust`` (one row for each ``__id``); texts shuffle only for very many ids."""
    small = trust.count() <= IDS_SENT
    return docs.join(F.broadcast(trust) if small else trust, F.col(key) == F.col("__id"), "left").drop("__id")


def count_cells(docs: DataFrame, text: str, chosen: Column, cells: int) -> DataFrame:
    """``cell, all_count, trusted_count`` over the n-grams of all texts, and of those ``chosen``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, cells), np.int64)
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column(0))
                mark = np.array(part.column(1).fill_null(False).to_pylist(), bool)
                _, _, hashes, owners, _ = document_words(data, offsets)
                cell, owner = gram_cells(hashes, owners, cells)
                counts[0] += np.bincount(cell, minlength=cells)
                counts[1] += np.bincount(cell[mark[owner]], minlength=cells)
        used = np.flatnonzero(counts[0])
        for start in range(0, len(used), 1 << 16):
            at = used[start : start + (1 << 16)]
            columns = [pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "all_count", "trusted_count"])

    found = docs.select(F.col(text).cast("string").alias("__text"), chosen.alias("__chosen")).mapInArrow(
        run, "cell long, all_count long, trusted_count long"
    )
    return found.groupBy("cell").agg(
        F.sum("all_count").alias("all_count"), F.sum("trusted_count").alias("trusted_count")
    )


def fit_weights(docs: DataFrame, chosen: Column, text: str = "text") -> RatioModel:
    """Weights from the counts of all documents and of those ``chosen`` (an expression over ``docs``).

    Without a chosen n-gram every weight is 0.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0]
    cells = cells_for(size or 0)
    counts = settled(count_cells(docs, text, chosen, cells), "cells")
    total, trusted = counts.agg(F.sum("all_count"), F.sum("trusted_count")).first()
    weights = np.zeros(cells, np.int32)
    if not trusted:
        return RatioModel(weights)
    share = lambda count, whole: F.log((F.col(count) + 1) / F.lit(float(whole + cells)))
    weighted = counts.select(
        "cell", F.round((share("trusted_count", trusted) - share("all_count", total)) * UNIT).cast("int").alias("weight")
    )
    rows = weighted.groupBy(F.expr(f"cell div {ROW}").alias("row")).agg(
        F.collect_list(F.struct((F.col("cell") % ROW).cast("int").alias("at"), "weight")).alias("cells")
    )
    for row in rows.select("row", "cells.at", "cells.weight").toLocalIterator():
        weights[np.array(row["at"]) + row["row"] * ROW] = row["weight"]
    return RatioModel(weights)


def score_documents(
    docs: DataFrame, model: RatioModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, the base counts, and ``score``: the mean weight of a text's n-grams in units, rounded down.

    Texts without words score 0. Rows are neither merged nor shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.weights)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights = held.value
        data, offsets = utf8(batch.column(1))
        rows = len(offsets) - 1
        counts = base_counts(data, offsets)
        _, _, hashes, owners, _ = document_words(data, offsets)
        cell, owner = gram_cells(hashes, owners, len(weights))
        grams = np.bincount(owner, minlength=rows)
        sums = per_document(weights[cell].astype(np.int64), owner, rows)
        counts["score"] = sums // np.maximum(grams, 1)
        columns = [pa.array(counts[n].astype(np.int64)) for n in names]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *names])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    return per_batch(rows, work, f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names))


def least_score(scores: DataFrame) -> int | None:
    """The threshold, from ``score, trusted`` of documents that took no part in the trusted counts.

    At most ``TAIL`` of the trusted ones lie below it; where the others, but for
    ``TAIL`` of them, lie lower still, it is the middle between the two. Only a
    count for each thousandth reaches the driver. None without trusted documents.
    """
    bins = scores.groupBy("trusted", F.floor(F.col("score") / 1000).alias("bin")).count().collect()

    def rank(trusted: bool, share: float) -> int | None:
        rows = sorted((r["bin"], r["count"]) for r in bins if r["trusted"] == trusted)
        total, passed = sum(c for _, c in rows), 0
        for value, count in rows:
            passed += count
            if passed > share * total:
                return value
        return rows[-1][0] if rows else None

    low, other = rank(True, TAIL), rank(False, 1 - TAIL)
    if low is None:
        return None
    return 1000 * ((low + other + 1) // 2 if other is not None and other < low else low)


def apply_quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    calibrate: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    least_words: int = 50,
    most_repeated: int = 50,
) -> DataFrame:
    """Every document's counts, ``base_failed``, ``score``, ``threshold`` and ``kept``.

    Trusted are documents all of whose labels are positive. Those for which
    ``calibrate`` (an expression over ``key``) holds set the threshold and stay
    out of the trusted counts. A document fails the base with fewer than
    ``least_words`` words, or when more than ``most_repeated`` per cent of its
    words lie in three-word windows that occur twice or more in it. It is kept if
    it passes the base and its score reaches the threshold; without trusted
    documents the base alone decides. NULL texts have no words; rows with one id
    or none each get their own verdict.
    """
    trust = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("__id"))
        .agg(F.min((F.col(label) > 0)).alias("__trusted"))
    )
    rows = docs.select(F.col(key), F.col(text))
    marked = with_trust(rows, key, trust.where("__trusted"))
    model = fit_weights(marked, F.coalesce(F.col("__trusted"), F.lit(False)) & ~calibrate, text)
    scored = settled(score_documents(rows, model, key, text), "ratios")
    seen = scored.join(trust, F.col(key) == F.col("__id")).where(
        calibrate & (F.col("n_words") >= least_words)
    )
    model.threshold = least_score(seen.select("score", F.col("__trusted").alias("trusted")))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    threshold = F.lit(model.threshold).cast("long")
    return scored.withColumns({"base_failed": failed, "threshold": threshold}).withColumn(
        "kept", ~failed & F.coalesce(F.col("score") >= F.col("threshold"), F.lit(True))
    )
