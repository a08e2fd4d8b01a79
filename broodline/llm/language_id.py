"""Language identification in two levels: family first, then the languages within it.

Texts become square roots of relative frequencies of hashed character 2- and
3-grams. Languages seen in training are grouped into families by the likeness
of their mean vectors. One-versus-one linear support vector machines choose the
family and then, within it, the language.

Defined results: a NULL text or one without a letter is ``und`` with score 0; a
text is never cut; with no labelled row everything is ``und``; with one language
everything with a letter is that language. Equal texts get equal results. Rows
are kept as they are, repeated or not; a NULL id counts as not held out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broodline.llm.arrays import code_points, hash_share, per_batch
from broodline.llm.graph import settled
from broodline.llm.labels import distinct_texts

#: Hash cells for each n-gram length.
CELLS = 2048
#: About so many labelled texts of each language are used to fit the machines.
ROWS_PER_LANGUAGE = 400
UNDETERMINED = "und"
#: A letter of any script; number signs, marks and symbols are none.
_LETTER = regex.compile(r"\p{L}")
_ROOT = 0x2C1B3C6D


def features(texts: list[str]) -> np.ndarray:
    """One row per text: two blocks of square roots of relative n-gram frequencies."""
    out = np.zeros((len(texts), 2 * CELLS), np.float32)
    for row, text in enumerate(texts):
        points, _ = code_points([text.lower()])
        ascii_other = (points < 128) & ((points < 97) | (points > 122))
        points = np.where(ascii_other, 32, points).astype(np.uint32)
        points = np.concatenate((np.full(1, 32, np.uint32), points, np.full(1, 32, np.uint32)))
        points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
        pairs = points[:-1] * np.uint32(0x01000193) + points[1:]
        triples = pairs[:-1] * np.uint32(0x01000193) + points[2:]
        for block, grams in enumerate((pairs, triples)):
            if len(grams):
                cells = (grams * np.uint32(_ROOT)) >> np.uint32(21)
                counts = np.bincount(cells, minlength=CELLS)
                out[row, block * CELLS : (block + 1) * CELLS] = np.sqrt(counts / len(grams))
    return out


@dataclass
class Machine:
    """A separating plane between two groups of names; positive sides with ``first``."""

    first: str
    second: str
    weights: np.ndarray
    bias: float


@dataclass
class LanguageModel:
    families: dict[str, list[str]] = field(default_factory=dict)
    between: list[Machine] = field(default_factory=list)
    within: dict[str, list[Machine]] = field(default_factory=dict)


def fit_plane(
    x: np.ndarray, kernel: np.ndarray, y: np.ndarray, steps: int = 200, cost: float = 30.0
) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient steps; both sides weigh the same.

    The plane is kept as a sum of the rows, so a step costs the square of their
    number whatever the width; ``kernel`` holds the products of the rows.
    """
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    part, bias = np.zeros(len(y), np.float32), 0.0
    fast, fast_bias = part, bias
    rate = 1.0 / (1.0 + 2 * cost * 3.0)
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (kernel @ fast + fast_bias)) * y * share
        next_part = (fast * (1 - rate * 1e-2) + rate * 2 * cost * slack).astype(np.float32)
        next_bias = fast_bias + rate * 2 * cost * slack.sum()
        pull = step / (step + 3)
        fast = (next_part + pull * (next_part - part)).astype(np.float32)
        fast_bias = next_bias + pull * (next_bias - bias)
        part, bias = next_part, next_bias
    return x.T @ part, float(bias)


def group_families(centres: dict[str, np.ndarray]) -> dict[str, list[str]]:
    """Average-link grouping of languages into about the square root of their number."""
    groups = [[name] for name in sorted(centres)]
    wanted = max(1, round(len(groups) ** 0.5))
    while len(groups) > wanted:
        likeness = {
            (i, j): np.mean([centres[a] @ centres[b] for a in groups[i] for b in groups[j]])
            for i in range(len(groups))
            for j in range(i + 1, len(groups))
        }
        i, j = max(likeness, key=likeness.get)
        groups[i] += groups.pop(j)
    return {"+".join(sorted(g)): sorted(g) for g in groups}


def machines(x: np.ndarray, names: np.ndarray) -> list[Machine]:
    """A plane between every two names, each fitted on the rows of these two alone."""
    found = sorted(set(names))
    out = []
    for i, first in enumerate(found):
        for second in found[i + 1 :]:
            rows = np.flatnonzero((names == first) | (names == second))
            side = np.where(names[rows] == first, 1.0, -1.0)
            own = x[rows]
            out.append(Machine(first, second, *fit_plane(own, own @ own.T, side)))
    return out


def vectors(rows: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.float16) for r in rows]).astype(np.float32)


def language_centres(rows: DataFrame) -> dict[str, np.ndarray]:
    """The mean vector of each language, of length 1; one row for each reaches the driver."""

    def mean(group: pa.Table) -> pa.Table:
        centre = vectors(sorted(group.column("row").to_pylist())).mean(axis=0)
        centre = (centre / np.linalg.norm(centre)).astype(np.float32).tobytes()
        return pa.table({"lang": group.column("lang").slice(0, 1), "centre": pa.array([centre], pa.binary())})

    found = rows.groupBy("lang").applyInArrow(mean, "lang string, centre binary").collect()
    return {r["lang"]: np.frombuffer(bytes(r["centre"]), np.float32) for r in sorted(found)}


def fitted_machines(rows: DataFrame, name: str) -> dict[str, list[Machine]]:
    """For each ``task`` of the rows, machines between the values of ``name``; a task is one group of rows."""
    kinds = {"task": pa.string(), "first": pa.string(), "second": pa.string(), "weights": pa.binary(), "bias": pa.float64()}

    def fit(group: pa.Table) -> pa.Table:
        own = sorted(zip(group.column(name).to_pylist(), group.column("row").to_pylist(), strict=True))
        found = machines(vectors([r for _, r in own]), np.array([n for n, _ in own]))
        task = group.column("task")[0].as_py()
        planes = [(task, str(m.first), str(m.second), m.weights.astype(np.float32).tobytes(), float(m.bias)) for m in found]
        return pa.table({n: pa.array([p[k] for p in planes], kind) for k, (n, kind) in enumerate(kinds.items())})

    schema = "task string, first string, second string, weights binary, bias double"
    out: dict[str, list[Machine]] = {}
    for r in sorted(rows.groupBy("task").applyInArrow(fit, schema).collect(), key=lambda r: (r["task"], r["first"], r["second"])):
        weights = np.frombuffer(bytes(r["weights"]), np.float32)
        out.setdefault(r["task"], []).append(Machine(r["first"], r["second"], weights, r["bias"]))
    return out


def fit_language_model(
    docs: DataFrame,
    use: Column,
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> LanguageModel:
    """Fit on a repeatable sample of about ``rows_per_language`` texts of each language, at most twice that.

    Only rows for which ``use`` holds are learnt from. The number of rows of each
    language is counted first, so the sample stays the same size on any input.
    Rows are chosen by a hash of the text and each text counts once, whatever
    its id. The machines of a family are fitted in one task from the rows of
    its languages, those between families from up to four times
    ``rows_per_language`` rows of each; the driver holds centres and planes only.
    """
    labelled = docs.where(use & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).agg(F.count(F.lit(1))).collect()}
    if not counts:
        return LanguageModel()
    share = F.lit(0.0)
    for name, count in counts.items():
        part = min(1.0, rows_per_language / count)
        share = F.when(F.col(lang) == name, F.lit(part)).otherwise(share)
    sample = distinct_texts(labelled.where(hash_share(text, share)), lang, text, 2 * rows_per_language)
    sample = sample.select(F.col("label").alias("lang"), "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        rows = [row.astype(np.float16).tobytes() for row in features(texts)]
        seen = [bool(_LETTER.search(t)) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(rows, pa.binary()), pa.array(seen)],
            ["lang", "row", "letters"],
        )

    found = per_batch(sample, work, "lang string, row binary, letters boolean").where("letters")
    rows = settled(found.select("lang", "row"), "language-rows")
    centres = language_centres(rows)
    if not centres:
        return LanguageModel()
    families = group_families(centres)
    family_of = {name: family for family, members in families.items() for name in members}
    family = F.create_map(*[F.lit(x) for pair in family_of.items() for x in pair])[F.col("lang")]
    placed = rows.withColumn("family", family)
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("row", F.lit("family")), "row"))
    few = placed.withColumn("place", place).where(F.col("place") <= 4 * rows_per_language)
    between = fitted_machines(few.select("row", "family", F.lit("").alias("task")), "family")
    within = fitted_machines(placed.select("row", "lang", F.col("family").alias("task")), "lang")
    return LanguageModel(families, between.get("", []), {name: within.get(name, []) for name in families})


def vote(x: np.ndarray, names: list[str], planes: list[Machine]) -> tuple[np.ndarray, np.ndarray]:
    """The name with the most wins and its mean certainty over its contests."""
    place = {name: i for i, name in enumerate(names)}
    trust = np.zeros((len(x), len(names)))
    wins = np.zeros((len(x), len(names)))
    for plane in planes:
        sure = 1 / (1 + np.exp(-4.0 * (x @ plane.weights + plane.bias).astype(np.float64)))
        for name, p in ((plane.first, sure), (plane.second, 1 - sure)):
            trust[:, place[name]] += p
            wins[:, place[name]] += p >= 0.5
    best = np.argmax(wins + trust / (len(names) + 1), axis=1)
    contests = max(len(names) - 1, 1)
    certain = trust[np.arange(len(x)), best] / contests if planes else np.ones(len(x))
    return best, certain


def predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    texts = [t or "" for t in texts]
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.families or not texts:
        return names, scores
    known = np.array([bool(_LETTER.search(t)) for t in texts])
    x = features(texts)
    families = sorted(model.families)
    family, sure = vote(x, families, model.between)
    for i, name in enumerate(families):
        rows = np.flatnonzero((family == i) & known)
        members = model.families[name]
        best, certain = vote(x[rows], members, model.within[name])
        for row, b, c in zip(rows, best, certain, strict=True):
            names[row], scores[row] = members[b], min(1.0, max(0.0, sure[row] * c))
    return names, scores


def identify_language(
    docs: DataFrame, model: LanguageModel, text: str = "text", name: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """All rows and columns, with the language (``name``) and ``score`` (0 to 1) added or replaced."""
    kept = [c for c in docs.columns if c not in (name, score)]
    fields = [f for f in docs.schema if f.name in kept]
    schema = docs.select(*kept).schema.add(name, "string").add(score, "double")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = predict(model, batch.column(text).to_pylist())
        columns = [batch.column(f.name) for f in fields]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            [*(f.name for f in fields), name, score],
        )

    return per_batch(docs.select(*kept), work, schema)
