"""Toxicity by cumulative-link ordinal regression over sparse text features.

Severity grades 0 to 3: label 0 is grade 0. Labels have two values, so documents of label 1 are graded on words that the
model doesn't see: a document's words at even and at odd positions are two halves, both train, and each one's grade comes from
how many words of the other are telling (thirds of the labelled halves that have some). One weight vector is shared by the
ordered thresholds: P(grade >= k) is sigmoid(w.x - t_k). A document is graded as it trains, by its halves: its expected
severity is the mean of theirs, each the sum of the chances over k = 1, 2, 3. It is toxic when w.x of its whole text reaches
the cut at which the fewest of the training documents, their whole texts scored alike, are on the wrong side.

Features are words, and beginnings of longer words (so that inflected forms share a feature). Of the training sample's all
those make the model that prefer label 1 beyond chance, by a likelihood-ratio test whose level accounts for the number
of candidates. A feature's value is log(1 + its count). Weights stay non-negative, so no amount of clean text hides an
insult and none makes one.

Fitted on at most ``SAMPLE_ROWS`` labelled rows that aren't held out. Every document is scored by its whole text.

Defined results: a null text is the empty text; equal texts score equally; a text without telling features has the base
severity of the model; without labels of both kinds, or features, severity is 0; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.bpe import rows_of
from bookflow.llm.common import remove
from bookflow.llm.labelled import SAMPLE_ROWS, held_out, training_rows
from bookflow.llm.telling import Sparse, solve, telling

WORD = re.compile(r"[^\W_]+")
#: Lengths of the beginnings of longer words.
BEGINNINGS = (4, 5, 6, 7, 8)
GRADES = 3
#: Words whose features a worker remembers.
CACHE_WORDS = 300_000


def word_features(word: str) -> list[str]:
    return [word, *(word[:k] + "+" for k in BEGINNINGS if len(word) > k)]


def text_features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}


def chosen_features(sample: DataFrame) -> list[str]:
    """Features that prefer label 1 beyond chance, the strongest first."""
    return distinct_features(telling(sample, text_features))


def distinct_features(ranked: list[tuple[str, int, int]]) -> list[str]:
    """Without the beginnings that occur just where a longer feature does: the longer one is the safer."""
    seen: set[tuple[str, int, int]] = set()
    kept = set()
    for feature, clean, toxic in sorted(ranked, key=lambda r: (-len(r[0].rstrip("+")), r[0])):
        stem = feature.rstrip("+")
        if (stem, clean, toxic) not in seen:
            kept.add(feature)
        seen.update((stem[:k], clean, toxic) for k in range(1, len(stem) + 1))
    return [r[0] for r in ranked if r[0] in kept]


class Counting:
    """Counts of the model's features in a text."""

    def __init__(self, features: list[str]):
        self.number = {f: k for k, f in enumerate(features)}
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        return tuple(self.number[f] for f in word_features(word) if f in self.number)

    def counts(self, words: list[str]) -> tuple[dict[int, int], int]:
        """(feature number to count, words that have a feature)."""
        distinct = set(words)
        for w in distinct.difference(self.known):
            self.known[w] = self._of(w)
        known = self.known
        telling = [w for w in distinct if known[w]]
        found: dict[int, int] = {}
        hits = 0
        if telling:
            times = Counter(words)
            for w in telling:
                hits += times[w]
                for k in known[w]:
                    found[k] = found.get(k, 0) + times[w]
        if len(known) > CACHE_WORDS:
            self.known = {}
        return found, hits


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def halves(text: str | None) -> tuple[list[str], list[str]]:
    """Words at even and at odd positions."""
    words = words_of(text)
    return words[::2], words[1::2]


def graded(counting: Counting, text: str | None) -> list[tuple[int, list[int], list[int], int]]:
    """For each half: its number, its features and their counts, and how many words of the other half are telling."""
    even, odd = (counting.counts(words) for words in halves(text))
    return [(k, list(own.keys()), list(own.values()), hits) for k, (own, hits) in enumerate(((even[0], odd[1]), (odd[0], even[1])))]


def fit(x: Sparse, grade: np.ndarray, ridge: float = 1e-5, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Shared non-negative weights and ordered thresholds: projected Newton steps on the cumulative-link likelihood."""
    share = np.array([(grade >= k).mean() for k in range(1, GRADES + 1)]).clip(1e-4, 1 - 1e-4)
    cuts = -np.log(share / (1 - share))
    cuts = np.maximum.accumulate(cuts + 1e-3 * np.arange(GRADES))
    w = np.zeros(x.shape[1])
    n = len(grade)
    rows = np.arange(n)
    squares = Sparse(x.row, x.column, x.value**2, x.shape)

    def loss(w: np.ndarray, cuts: np.ndarray) -> float:
        above = np.c_[np.ones(n), 1 / (1 + np.exp(-np.clip(x.dot(w)[:, None] - cuts, -30, 30))), np.zeros(n)]
        return float(-np.log(np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)).mean() + ridge / 2 * w @ w)

    for _ in range(steps):
        above = np.c_[np.ones(n), 1 / (1 + np.exp(-np.clip(x.dot(w)[:, None] - cuts, -30, 30))), np.zeros(n)]
        slope = above * (1 - above)
        chance = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)
        gradient = x.dot_rows(above[rows, grade] + above[rows, grade + 1] - 1) / n + ridge * w
        free = (w > 0) | (gradient < 0)
        curved = (slope[rows, grade] + slope[rows, grade + 1]) / n
        diagonal = squares.dot_rows(curved) + ridge
        step = solve(lambda v: np.where(free, x.dot_rows(curved * x.dot(v)) + ridge * v, 0), np.where(free, gradient, 0), lambda v: v / diagonal)
        by_cut, size = np.zeros(GRADES + 2), np.zeros(GRADES + 2)
        for at, sign in ((grade, 1), (grade + 1, -1)):
            part = sign * slope[rows, at] / chance / n
            np.add.at(by_cut, at, part)
            np.add.at(size, at, part * part * n)
        cut_step = by_cut[1:-1] / np.maximum(size[1:-1], 1e-6)
        before, rate = loss(w, cuts), 1.0
        while rate > 1e-4:
            new, moved = np.maximum(w - rate * step, 0), np.maximum.accumulate(cuts - rate * cut_step + 1e-6 * np.arange(GRADES))
            if loss(new, moved) < before:
                break
            rate /= 2
        if rate <= 1e-4:
            break
        w, cuts = new, moved
    return w, cuts


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The model. The driver gathers the telling features, and of at most ``rows`` documents their halves' counts of these."""
    sample, held = training_rows(docs, labels, target, rows, id_col, text_col)
    features = chosen_features(sample)
    if not features:
        remove(docs.sparkSession, held)
        return None
    spec = docs.sparkSession.sparkContext.broadcast(features)

    def run(batches):
        counting = Counting(spec.value)
        for batch in (part for whole in batches for part in rows_of(whole)):
            rows = [(i, label, *x) for i, label, text in zip(*(c.to_pylist() for c in batch.columns)) for x in graded(counting, text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=["id", "label", "half", "at", "n", "hits"])

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
    found = sample.select("id", "label", "text").mapInArrow(run, "id long, label int, half int, at array<long>, n array<long>, hits long").toPandas().sort_values(["id", "half"])
    remove(docs.sparkSession, held)
    x = Sparse.of_rows(((at, np.log1p(np.asarray(n, float))) for at, n in zip(found["at"], found["n"])), len(features))
    hits = found["hits"].to_numpy()
    toxic = found["label"].to_numpy() == 1
    telling = toxic & (hits > 0)
    grade = toxic.astype(int)
    if telling.any():
        low, high = np.quantile(hits[telling], [1 / 3, 2 / 3])
        grade[telling] += (hits[telling] > low).astype(int) + (hits[telling] > high)
    weights, cuts = fit(x, grade)
    whole = [total_of(weights, merged(*pair)) for pair in pairs(dict(zip(at, n)) for at, n in zip(found["at"], found["n"]))]
    return {"features": features, "weights": weights, "cuts": cuts, "toxic_from": fewest_errors(np.array(whole), toxic[::2])}


def pairs(items: Iterable) -> Iterator[tuple]:
    items = iter(items)
    return zip(items, items)


def merged(even: dict[int, int], odd: dict[int, int]) -> dict[int, int]:
    """Counts of a whole text from its halves'."""
    return even | {k: even.get(k, 0) + n for k, n in odd.items()}


def total_of(weights: np.ndarray, found: dict[int, int]) -> float:
    return float(sum(weights[k] * np.log1p(n) for k, n in sorted(found.items())))


def fewest_errors(values: np.ndarray, toxic: np.ndarray) -> float:
    """The boundary from which values count as toxic with the fewest errors: half way between two values, the lowest of equals.
    A text without weight is never toxic."""
    order = np.argsort(values, kind="stable")
    values, toxic = values[order], toxic[order]
    wrong = np.r_[0, np.cumsum(toxic)] + np.r_[np.cumsum(~toxic[::-1])[::-1], 0]  # toxic ones below the boundary, clean ones above
    ends = np.flatnonzero(np.r_[False, (values[1:] > values[:-1]) & (values[1:] > 0), True])  # boundaries between unlike values
    best = int(ends[np.argmin(wrong[ends])])
    return float((values[best - 1] + values[best]) / 2) if best < len(values) else float(values[-1] + 1)


class Scorer:
    def __init__(self, model: dict | None):
        self.model = model
        self.counting = Counting(model["features"]) if model else None

    def of(self, text: str | None) -> tuple[float, bool]:
        """(expected severity, toxic)."""
        if self.model is None:
            return 0.0, False
        weights = self.model["weights"]
        even, odd = (self.counting.counts(words)[0] for words in halves(text))
        total = np.array([total_of(weights, even), total_of(weights, odd)])
        chances = 1 / (1 + np.exp(-np.clip(total[:, None] - self.model["cuts"], -30, 30)))
        return float(chances.sum(axis=1).mean()), total_of(weights, merged(even, odd)) >= self.model["toxic_from"]


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, toxic) of every document: expected severity 0 to 3, and 1 for a toxic one."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value)
        for batch in (part for whole in batches for part in rows_of(whole)):
            found = [scorer.of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([int(t) for _, t in found], pa.int32())], names=["id", "severity", "toxic"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, severity double, toxic int").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, severity, toxic)."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    return score(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "severity", "toxic")


def keep_clean(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(model.value)
        for batch in (part for whole in batches for part in rows_of(whole)):
            yield batch.filter(pa.array([not scorer.of(t)[1] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
