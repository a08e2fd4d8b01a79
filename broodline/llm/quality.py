"""Quality classifier: random-indexing word vectors, pooled, and a small numpy network.

Words and runs of marks are hashed to cells, apart by shape (lower case,
capitalised, upper case, marks and digits). Every cell has a fixed sparse random
index vector; its context vector is the sum of the index vectors of its
neighbours over *all* documents. A document is the mean and the deviation of the
context vectors of its tokens. A network with one hidden layer is fitted to a
bounded labelled sample, and a temperature on rows kept apart makes its outputs
probabilities.

Defined results: NULL and empty texts score as documents without tokens (all
zeros); texts are never cut; equal texts score equally; repeated ids keep their
rows; without labelled rows of both classes every score is the share of good
rows, or 1 when nothing is labelled, so that nothing is rejected unlearnt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broodline.llm.arrays import WORDS_AND_MARKS, mix, per_batch, slices, tokens, utf8
from broodline.llm.labels import labelled_sample

#: Cells for each of four shapes, numbers of a context vector, entries of an index vector.
CELLS, WIDTH, ENTRIES = 1024, 48, 4
#: Words to each side that count as neighbours.
REACH = 2
#: About so many labelled texts of each class are learnt from.
ROWS_PER_CLASS = 4000
HIDDEN = 24


def index_vectors() -> np.ndarray:
    """The sparse random vector of each cell: ``ENTRIES`` places with a sign."""
    seeds = np.arange(4 * CELLS * ENTRIES, dtype=np.uint64).reshape(-1, ENTRIES)
    drawn = mix(seeds + np.uint64(0x5EED))
    places = (drawn % np.uint64(WIDTH)).astype(np.int64)
    signs = np.where((drawn >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    return np.stack([places.astype(np.float64), signs])


def cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of every token and the first token of every row (one more than rows)."""
    starts, ends, hashes = tokens(data, offsets, WORDS_AND_MARKS)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = data[starts]
    last = data[ends - 1]
    upper_first = (first >= 65) & (first <= 90)
    upper_last = (last >= 65) & (last <= 90)
    shape = np.where(upper_first, np.where(upper_last & (ends - starts > 1), 2, 1), 0)
    marks = (WORDS_AND_MARKS[first] == 2) | ((first >= 48) & (first <= 57))
    shape = np.where(marks, 3, shape)
    return shape * CELLS + (hashes % np.uint64(CELLS)).astype(np.int64), np.searchsorted(
        starts, offsets
    )


def context_sums(tokens_of: np.ndarray, begins: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Context vectors of one batch: neighbours never reach over the end of a row."""
    places, signs = index[0].astype(np.int64), index[1]
    size = 4 * CELLS * WIDTH
    out = np.zeros(size)
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    for step in range(1, REACH + 1):
        same = row[step:] == row[:-step]
        left, right = tokens_of[:-step][same], tokens_of[step:][same]
        for word, near in ((left, right), (right, left)):
            for entry in range(ENTRIES):
                spots = word * WIDTH + places[near, entry]
                out += np.bincount(spots, weights=signs[near, entry], minlength=size)
    return out.reshape(4 * CELLS, WIDTH)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context vectors of all cells over the whole corpus, each of length 1 or 0.

    A task sends one row for each cell it has seen, however much it has read;
    the result has a fixed size.
    """
    names = [f"v{i}" for i in range(WIDTH)]
    schema = "cell int, " + ", ".join(f"{n} float" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total = np.zeros((4 * CELLS, WIDTH))
        for batch in batches:
            for part in slices(batch):
                total += context_sums(*cells(*utf8(part.column(0))), index)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        columns = [pa.array(used.astype(np.int32))]
        columns += [pa.array(total[used, i].astype(np.float32)) for i in range(WIDTH)]
        yield pa.RecordBatch.from_arrays(columns, ["cell", *names])

    sums = docs.select(text).mapInArrow(run, schema)
    rows = sums.groupBy("cell").agg(*[F.sum(n).alias(n) for n in names]).collect()
    vectors = np.zeros((4 * CELLS, WIDTH))
    for r in rows:
        vectors[r[0]] = r[1:]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the token vectors of every row."""
    tokens_of, begins = cells(data, offsets)
    rows = len(offsets) - 1
    counts = np.diff(begins)
    out = np.zeros((rows, 2 * WIDTH))
    for row in range(rows):
        if counts[row]:
            own = np.bincount(tokens_of[begins[row] : begins[row + 1]], minlength=4 * CELLS)
            used = np.flatnonzero(own)
            shares = own[used] / counts[row]
            mean = shares @ vectors[used]
            square = shares @ (vectors[used].astype(np.float64) ** 2)
            out[row, :WIDTH] = mean
            out[row, WIDTH:] = np.sqrt(np.maximum(square - mean**2, 0))
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    temperature: float
    share: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        return np.tanh(z @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train_network(x: np.ndarray, y: np.ndarray, epochs: int = 400) -> tuple:
    """Full-batch Adam on the log loss; weights start from a fixed seed."""
    draw = np.random.default_rng(7)
    params = [
        draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        draw.normal(0, HIDDEN**-0.5, HIDDEN),
        np.zeros(1),
    ]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for epoch in range(1, epochs + 1):
        hidden = np.tanh(x @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -50, 50)))
        error = (p - y) / len(y)
        back = np.outer(error, params[2]) * (1 - hidden**2)
        grads = [x.T @ back + 2e-4 * params[0], back.sum(0), hidden.T @ error + 2e-4 * params[2], error.sum(keepdims=True)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            step = first[i] / (1 - 0.9**epoch)
            params[i] = params[i] - 0.01 * step / (np.sqrt(second[i] / (1 - 0.999**epoch)) + 1e-8)
    return params[0], params[1], params[2], float(params[3][0])


def best_temperature(logits: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows kept apart."""
    tried = np.geomspace(0.25, 8, 60)
    signed = logits * (2 * y - 1)
    losses = [(weights * np.logaddexp(0, -signed / t)).sum() for t in tried]
    return float(tried[int(np.argmin(losses))])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    label: str = "quality",
    rows_per_class: int = ROWS_PER_CLASS,
    text: str = "text",
    key: str = "doc_id",
) -> QualityModel:
    """Word vectors from all documents, the network from a bounded labelled sample.

    Classes are sampled at different rates; their natural shares come back as a
    shift of the logit, so scores are probabilities on the whole table.
    """
    vectors = word_vectors(docs, text)
    sample = labelled_sample(docs, labels, label, rows_per_class, use, key, text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pooled(*utf8(batch.column("text")), vectors)
        return pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())],
            ["label", "row"],
        )

    rows = per_batch(sample, work, "label int, row binary").collect()
    rows = sorted((r["label"], bytes(r["row"])) for r in rows)
    natural = labels.where(use & F.col(label).isNotNull()).agg(
        F.avg((F.col(label) > 0).cast("double"))
    ).first()[0]
    nothing = np.zeros(2 * WIDTH)
    model = QualityModel(vectors, nothing, nothing + 1, None, 1.0, 1.0 if natural is None else natural)
    y = np.array([r[0] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return model
    x = np.stack([np.frombuffer(r[1], np.float32) for r in rows]).astype(np.float64)
    apart = np.arange(len(y)) % 5 == 0
    if not 0 < y[~apart].sum() < (~apart).sum():
        apart[:] = False
    model.centre, model.spread = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - model.centre) / model.spread, -8, 8)
    a, b, c, d = train_network(z[~apart], y[~apart])
    natural = min(max(natural, 1e-3), 1 - 1e-3)
    drawn = y.mean()
    shift = np.log(natural / (1 - natural)) - np.log(drawn / (1 - drawn))
    model.layers = (a, b, c, d + shift)
    if apart.any():
        weights = np.where(y == 1, natural / drawn, (1 - natural) / (1 - drawn))
        model.temperature = best_temperature(model.logits(x[apart]), y[apart], weights[apart])
    return model


def score_quality(
    docs: DataFrame, model: QualityModel, text: str = "text", name: str = "score"
) -> DataFrame:
    """All rows and columns, with the probability of good quality added or replaced."""
    kept = [c for c in docs.columns if c != name]
    schema = docs.select(*kept).schema.add(name, "double")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.scores(pooled(*utf8(batch.column(text)), model.vectors))
        columns = [batch.column(c) for c in kept]
        return pa.RecordBatch.from_arrays([*columns, pa.array(scores)], [*kept, name])

    return per_batch(docs.select(*kept), work, schema)
