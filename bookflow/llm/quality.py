"""Quality classifier by Bradley-Terry pairwise ranking.

Each document has features of its text alone. Dense ones: what characters it is made of, how its words and lines repeat, how
long they are, each bent at quantile knots. Sparse ones, learned: the words that prefer one label beyond chance in the
training sample (all of them), by their share of the text. Preference pairs set a document of label 1 against one of label 0; a
weight vector over both kinds is fitted so that the score difference explains the preferences (logistic loss on feature
differences; Newton steps, each solved by conjugate gradients). The threshold is the quantile of the training scores at the
share of label 0, and scores are shifted on the logistic scale so that it lies at 0.3.

Two fits. ``whole``, which the queries use: every labelled row that isn't held out gives words, means, knots, the threshold
and the model, and every row of label 1 is set against every row of label 0. The pairs aren't listed: what a row adds to
the gradient depends on its score and the other label's scores alone, so scores are counted in bins of 1 / ``BINS`` (each
stands for the mean of its scores), and each evaluation is two Spark jobs over the stored features. Steps are quasi-Newton ones.
Otherwise, for a fit of bounded cost: at most ``SAMPLE_ROWS`` labelled rows, in ``PAIRS`` pairs drawn of them with a fixed seed.
Either way every document is scored by its whole text.

Defined results: a null text is the empty text and has a score too; equal texts have equal scores; without labels of
both kinds every score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.bpe import chunks, rows_of
from bookflow.llm.common import materialize, remove
from bookflow.llm.labelled import SAMPLE_ROWS, held_out, training_rows
from bookflow.llm.telling import Sparse, solve, telling
from bookflow.operators.quantile import exact_percentiles

CUT = 0.3
#: Preference pairs that a model is fitted on.
PAIRS = 30_000
#: Ridge of the weights of dense and of sparse features.
RIDGE, SPARSE_RIDGE = 3e-3, 3e-2
#: Bins of scores to a unit, and the score beyond which chances are taken as there.
BINS, EDGE = 32, 40
#: Places of a vector that are summed together.
STRETCH = 4_096
#: Steps of a fit after which the curvature is looked at anew.
FRESH = 4
#: A fit ends when half of this is about what the mean loss may still fall by.
END = 1e-8
GRID = np.arange(-EDGE * BINS, EDGE * BINS + 1) / BINS
#: Blocks of stored examples in a row group, at most: a reader takes a row group as a batch, whatever its bytes.
GROUP = {"parquet.block.row.count.limit": 8}
SYMBOLS = "!|*$%#&@~^=_+<>{}[]\\/"
_KINDS = np.array([0 if c.isspace() else 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?'\"()-" else 5 for c in map(chr, range(0x250))] + [6], np.uint8)
#: Characters by kind, and where each kind begins among them.
_BY_KIND = np.argsort(_KINDS, kind="stable")
_KIND_AT = np.searchsorted(_KINDS[_BY_KIND], range(7))
#: White space, as words are split at it; there is none beyond.
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
#: Quantile knots at which each feature may bend.
KNOTS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98)


def features(text: str) -> list[float]:
    """The dense features of one text."""
    return measured([text], {})[0][0].tolist()


def measured(texts: list[str], number: dict[str, int]) -> tuple[np.ndarray, Sparse]:
    """Dense features of texts, and the sparse ones: log(1 + times per hundred words) of the words that ``number`` numbers.

    A word of a text goes by the place where it stands first, counted through all texts; the rest are sums over places.
    """
    m = len(texts)
    at, nw, upper, found, numbers = [], [], [], [], []
    for text in texts:
        words, place = text.split(), {}
        at += map(place.setdefault, words, range(len(at), len(at) + len(words)))
        nw.append(len(words))
        upper.append(sum(len(w) > 1 for w in filter(str.isupper, words)))
        known = list(filter(number.__contains__, place))
        found += map(place.__getitem__, known)
        numbers += map(number.__getitem__, known)
    at, nw, found, numbers = (np.array(x, np.int64) for x in (at, nw, found, numbers))
    total = len(at)
    n = np.fromiter(map(len, texts), np.int64, m)
    code = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    space = _SPACE[np.minimum(code, len(_SPACE) - 1)]
    ends = np.flatnonzero(space[1:] & ~space[:-1])
    size = ends - np.flatnonzero(space[:-1] & ~space[1:])
    last, kind = np.unique(code[ends], return_inverse=True)
    last = list(map(chr, last.tolist()))
    chars = np.array([np.bincount(np.minimum(code[b - k : b], 0x250), minlength=0x251) for k, b in zip(n, np.cumsum(n + 1))])

    row = np.repeat(np.arange(m), nw)
    times = np.bincount(at, minlength=total)
    held = np.flatnonzero(times)
    held_row, held_times = row[held], times[held]
    distinct = np.bincount(held_row, minlength=m)
    most = times.max(initial=0) + 1
    ranked = most - np.sort(held_row * most + most - held_times) % most  # each text's counts, the highest first
    first = np.cumsum(distinct) - distinct
    top = [np.where(distinct > k, np.r_[ranked, 0, 0][np.minimum(first + k, len(ranked))], 0) for k in (0, 1)]
    inside = row[1:] == row[:-1]
    pairs = np.sort((at[:-1] * total + at[1:])[inside])
    pairs = pairs[np.diff(pairs, prepend=-1) > 0] // max(1, total)

    def ends_that(holds: Callable[[str], bool]) -> np.ndarray:
        return np.bincount(row[np.fromiter(map(holds, last), bool, len(last))[kind]], minlength=m)

    kinds = np.add.reduceat(chars[:, _BY_KIND], _KIND_AT, axis=1).T
    lines = [_lines(t) for t in texts]
    line_count, other_lines, repeated = (np.array(x, np.int64) for x in zip(*lines))
    letters, some, each = np.maximum(1, kinds[1] + kinds[2] + kinds[6]), np.maximum(1, n), np.maximum(1, nw)
    x = [
        np.log1p(nw),
        np.log1p(n),
        np.bincount(row, size, m) / each,
        kinds[1] / letters,
        letters / some,
        kinds[3] / some,
        kinds[4] / some,
        kinds[5] / some,
        chars[:, list(map(ord, SYMBOLS))].sum(axis=1) / some,
        chars[:, ord("|")] / each,
        chars[:, ord("!")] / each,
        distinct / each,
        top[0] / each,
        (top[0] + top[1]) / each,
        np.bincount(row[1:][inside & (at[1:] == at[:-1])], minlength=m) / each,
        np.bincount(row[pairs], minlength=m) / each,
        np.bincount(held_row[size[held] <= 3], minlength=m) / np.maximum(1, distinct),
        np.bincount(held_row[size[held] >= 12], minlength=m) / np.maximum(1, distinct),
        1 - other_lines / line_count,
        repeated / some,
        np.log1p(line_count),
        np.log1p(n / line_count),
        ends_that(".!?".__contains__) / each,
        np.array(upper, np.int64) / each,
        np.fromiter((t.count("http") for t in texts), np.int64, m) / each,
        ends_that(lambda c: not c.isalnum()) / each,
    ]
    order = np.argsort(row[found] * max(1, len(number)) + numbers)
    found, in_row = found[order], row[found[order]]
    return np.array(x).T.copy(), Sparse(in_row, numbers[order], np.log1p(100 * times[found] / nw[in_row]), (m, len(number)))


def _lines(text: str) -> tuple[int, int, int]:
    """(lines, distinct ones, characters of the line that comes most often, if more than once)."""
    lines = text.split("\n")
    different = len(set(lines))
    if different == len(lines):
        return len(lines), different, 0
    line, times = Counter(lines).most_common(1)[0]
    return len(lines), different, times * (len(line) + 1)


def basis(x: np.ndarray, model: dict) -> np.ndarray:
    """Each feature, standardised and clipped, and its bends at the knots: an additive piecewise-linear score."""
    z = np.clip((x - model["mean"]) / model["std"], -6, 6)
    return np.concatenate([z] + [np.maximum(0, z - k) for k in model["knots"]], axis=1)


def fit(x: np.ndarray, y: np.ndarray, sparse: Sparse | None = None, pairs: int = PAIRS, steps: int = 20, seed: int = 7) -> dict | None:
    """Weights from preference pairs; None without both labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    sparse = sparse or Sparse.of(np.zeros((len(y), 0)))
    model = {"mean": x.mean(axis=0), "std": x.std(axis=0) + 1e-9}
    z = np.clip((x - model["mean"]) / model["std"], -6, 6)
    model["knots"] = np.quantile(z, KNOTS, axis=0)
    b = basis(x, model)
    wide = b.shape[1]
    rng = np.random.default_rng(seed)
    left, right = rng.choice(good, pairs), rng.choice(bad, pairs)
    ridge = np.r_[np.full(wide, RIDGE), np.full(sparse.shape[1], SPARSE_RIDGE)]

    def score_of(w: np.ndarray) -> np.ndarray:
        return b @ w[:wide] + sparse.dot(w[wide:])

    def gathered(by_pair: np.ndarray) -> np.ndarray:
        """The transpose of the pairs' feature differences, times ``by_pair``."""
        by_row = np.bincount(left, by_pair, len(y)) - np.bincount(right, by_pair, len(y))
        return np.r_[by_row @ b, sparse.dot_rows(by_row)]

    # About what the curvature is at equal chances: the dense features' covariance, the sparse ones' squares.
    covariance = np.cov(b.T, bias=True)
    squares = Sparse(sparse.row, sparse.column, sparse.value**2, sparse.shape).dot_rows(np.full(len(y), 1 / len(y)))
    w = np.zeros(len(ridge))
    for _ in range(steps):
        s = score_of(w)
        p = 1 / (1 + np.exp(np.clip(s[left] - s[right], -30, 30)))  # the chance that the model gives to the other order
        curved = p * (1 - p) / pairs

        def curvature(v: np.ndarray) -> np.ndarray:
            t = score_of(v)
            return gathered(curved * (t[left] - t[right])) + ridge * v

        dense = np.linalg.inv(2 * curved.sum() * covariance + RIDGE * np.eye(wide))
        diagonal = 2 * curved.sum() * squares + SPARSE_RIDGE
        step = solve(curvature, ridge * w - gathered(p / pairs), lambda v: np.r_[dense @ v[:wide], v[wide:] / diagonal])
        w -= step
        if np.abs(score_of(step)).max() < 1e-3:
            break
    raw = score_of(w)
    model |= {"weights": w[:wide], "sparse": w[wide:], "cut": float(np.quantile(raw, len(bad) / len(y))), "scale": float(1 / max(raw.std(), 1e-9))}
    return model


class Scorer:
    """Scores of texts; 0.5 without a model."""

    def __init__(self, model: dict | None):
        self.model = model
        self.number = {w: k for k, w in enumerate(model["words"])} if model else {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None or not texts:
            return np.full(len(texts), 0.5)
        m = self.model
        raw = []
        for part in chunks(texts):
            x, sparse = measured(part, self.number)
            raw.append((basis(x, m) * m["weights"]).sum(axis=1) + sparse.dot(m["sparse"]))  # row by row: the same wherever a text stands
        return 1 / (1 + np.exp(-np.clip((np.concatenate(raw) - m["cut"]) * 2 * m["scale"] + np.log(CUT / (1 - CUT)), -30, 30)))


def examples(sample: DataFrame, words: list[str]) -> DataFrame:
    """(id, label, x, size, at, n): the features of training rows, each column the bytes of an array over some 256 rows, so that a step
    of a fit reads them without a look at each value. ``size``: a row's sparse features; ``at``, ``n``: their numbers and values."""
    spec = sample.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        number = {w: k for k, w in enumerate(spec.value)}
        for batch in (part for whole in batches for part in rows_of(whole)):
            done = 0
            for texts in chunks(batch.column(2).to_pylist()):
                x, sparse = measured(texts, number)
                ids, labels = (batch.column(k).slice(done, len(texts)).to_numpy().astype(kind) for k, kind in ((0, "<i8"), (1, "<i4")))
                done += len(texts)
                size = np.bincount(sparse.row, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (ids, labels, x, size, sparse.column.astype("<i4"), sparse.value)], names=["id", "label", "x", "size", "at", "n"])

    return sample.select("id", "label", "text").mapInArrow(run, "id binary, label binary, x binary, size binary, at binary, n binary")


def flat(table: pa.Table | pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def arrays(table: pa.Table | pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, Sparse]:
    """(labels, dense features, sparse ones) of blocks of :func:`examples`."""
    y = flat(table, "label", "<i4")
    row = np.repeat(np.arange(len(y)), flat(table, "size", "<i8"))
    return y, flat(table, "x", "<f8").reshape(len(y), -1), Sparse(row, flat(table, "at", "<i4").astype(np.int64), flat(table, "n", "<f8"), (len(y), width))


def summed(rows: DataFrame, width: int, of: Callable[[np.ndarray, np.ndarray, Sparse], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of a vector: a task adds up its own; the tasks' meet by stretches of ``STRETCH`` places."""

    def stretches(totals):
        return pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.int64()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], names=["k", "v"])

    def run(batches):
        total = np.zeros(size)
        for batch in (part for whole in batches for part in rows_of(whole, 8)):
            total += of(*arrays(batch, width))
        yield stretches({k: total[k * STRETCH : (k + 1) * STRETCH] for k in range(-(-size // STRETCH))})

    def meet(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[k] = totals.get(k, 0) + np.frombuffer(v)
        yield stretches(totals)

    found = rows.mapInArrow(run, "k long, v binary").repartition("k").mapInArrow(meet, "k long, v binary").toArrow()
    parts = dict(zip(found.column("k").to_pylist(), found.column("v").to_pylist()))
    return np.concatenate([np.frombuffer(parts[k]) for k in sorted(parts)]) if parts else np.zeros(size)


def chances(hist: np.ndarray) -> tuple[float, np.ndarray]:
    """From (label, number and sum of scores, bin): the mean loss of all pairs; on ``GRID``, for a row of label 0 and of label 1, the mean
    chance p that the model gives to the other order, and the mean p(1 - p), each over the other label's rows and by row."""
    (m0, n0), (m1, n1) = ((total[n > 0] / n[n > 0], n[n > 0] / n.sum()) for n, total in hist)
    p0, p1 = (1 / (1 + np.exp(np.clip(d, -30, 30))) for d in (m1 - GRID[:, None], GRID[:, None] - m0))
    size0, size1 = hist[:, 0].sum(axis=1)
    return float(n1 @ np.logaddexp(0, m0 - m1[:, None]) @ n0), np.array([[p0 @ n1, (p0 * (1 - p0)) @ n1], [-(p1 @ n0), (p1 * (1 - p1)) @ n0]]) / np.array([size0, size1])[:, None, None]


def fit_whole(rows: DataFrame, width: int, steps: int = 100, memory: int = 12) -> dict | None:
    """Weights from all pairs of all ``rows``; None without both labels. The driver holds vectors of a weight a feature."""
    size = summed(rows, width, lambda y, x, sparse: np.bincount(y, minlength=2).astype(float), 2)
    if not size.all():
        return None

    def values(batches):
        for batch in (part for whole in batches for part in rows_of(whole, 8)):
            _, x, _ = arrays(batch, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(x.shape[1], dtype=np.int32), len(x))), pa.array(x.ravel())], names=["k", "v"])

    each = rows.mapInArrow(values, "k int, v double").groupBy("k")
    found = each.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile_approx("v", list(KNOTS), 10_000).alias("knots")).orderBy("k").collect()
    model = {"mean": np.array([r["mean"] for r in found]), "std": np.array([r["std"] for r in found]) + 1e-9}
    model["knots"] = np.clip((np.array([r["knots"] for r in found]).T - model["mean"]) / model["std"], -6, 6)
    wide = len(found) * (1 + len(KNOTS))
    ridge = np.r_[np.full(wide, RIDGE), np.full(width, SPARSE_RIDGE)]

    def scores(w, x, sparse):
        b = basis(x, model)
        return b, b @ w[:wide] + sparse.dot(w[wide:])

    def histogram(w):
        def of(y, x, sparse):
            s = scores(w, x, sparse)[1]
            at = (np.clip(np.rint(s * BINS), -EDGE * BINS, EDGE * BINS) + EDGE * BINS).astype(np.int64)
            return np.concatenate([np.bincount(at[y == k], weights, len(GRID)) for k in (0, 1) for weights in (None, s[y == k])])

        return summed(rows, width, of, 4 * len(GRID)).reshape(2, 2, len(GRID))

    upper = np.triu_indices(wide)
    parts = np.cumsum([wide + width, len(upper[0]), 2 * wide, 2])

    def slope(w, at_score, easy=None):
        """The gradient, and what solves about the curvature (where none is given): as if a pair's weight were the product of its rows' weights."""

        def of(y, x, sparse):
            b, s = scores(w, x, sparse)
            c, a = (np.where(y == 1, np.interp(s, GRID, at_score[1, k]), np.interp(s, GRID, at_score[0, k])) for k in (0, 1))
            turn = [c @ b, sparse.dot_rows(c)]
            if easy:
                return np.concatenate(turn)
            squares = Sparse(sparse.row, sparse.column, sparse.value**2, sparse.shape).dot_rows(a)
            sides = [(a * (y == k)) for k in (0, 1)]
            return np.concatenate([*turn, ((b * a[:, None]).T @ b)[upper], *(v @ b for v in sides), [v.sum() for v in sides], squares])

        if easy:
            return summed(rows, width, of, wide + width) + ridge * w, easy
        g, triangle, means, total, squares = np.split(summed(rows, width, of, int(parts[-1]) + width), parts)
        curved = np.zeros((wide, wide))
        curved[upper] = triangle
        curved = curved + np.triu(curved, 1).T
        both = np.outer(means[:wide], means[wide:]) / max(np.sqrt(total.prod()), 1e-300)
        solved = np.linalg.inv(curved - both - both.T + RIDGE * np.eye(wide))
        return g + ridge * w, lambda v: np.r_[solved @ v[:wide], v[wide:] / (squares + SPARSE_RIDGE)]

    w = np.zeros(len(ridge))
    loss, at_score = chances(histogram(w))
    (g, easy), past = slope(w, at_score), []
    for step in range(1, steps + 1):
        if g @ easy(g) < END:
            break
        v, held = g.copy(), []
        for d, change in reversed(past):
            held.append((d @ v) / (d @ change))
            v -= held[-1] * change
        v = easy(v)
        for (d, change), a in zip(past, reversed(held)):
            v += (a - (change @ v) / (d @ change)) * d
        part = 1.0
        while part > 1e-3:
            new = w - part * v
            after, at_score = chances(histogram(new))
            after += 0.5 * ridge @ new**2
            if after <= loss - 1e-4 * part * (g @ v) + 1e-7:
                break
            part /= 2
        else:
            break
        turned, easy = slope(new, at_score, easy if step % FRESH else None)
        if (new - w) @ (turned - g) > 0:
            past = [*past, (new - w, turned - g)][-memory:]
        w, g, loss = new, turned, after

    def raw(batches):
        for batch in (part for whole in batches for part in rows_of(whole, 8)):
            _, x, sparse = arrays(batch, width)
            yield pa.RecordBatch.from_arrays([pa.array(scores(w, x, sparse)[1])], names=["raw"])

    scored, folder = materialize(rows.mapInArrow(raw, "raw double"), "training-scores")
    cut = exact_percentiles(scored, "raw", [float(size[0] / size.sum())]).first()[0]
    spread = scored.agg(F.stddev_pop("raw")).first()[0]
    remove(rows.sparkSession, folder)
    return model | {"weights": w[:wide], "sparse": w[wide:], "cut": float(cut[0] if isinstance(cut, list) else cut), "scale": float(1 / max(spread, 1e-9))}


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> dict | None:
    """The model, from all training rows (``whole``) or from at most ``rows``. The driver gathers the telling words, and of a bounded
    fit the features of its rows."""
    sample, held = training_rows(docs, labels, target, None if whole else rows, id_col, text_col)
    words = [w for w, *_ in telling(sample, lambda text: set(text.split()), either=True)]
    if whole:
        stored, folder = materialize(examples(sample, words), "examples", **GROUP)
        remove(docs.sparkSession, held)
        model = fit_whole(stored.drop("id"), len(words))
        remove(docs.sparkSession, folder)
        return model and model | {"words": words}
    table = examples(sample, words).toArrow()
    remove(docs.sparkSession, held)
    if not table.num_rows:
        return None
    y, x, sparse = arrays(table, len(words))
    order = np.argsort(flat(table, "id", "<i8"))
    row = np.argsort(order)[sparse.row]
    by_row = np.argsort(row, kind="stable")
    model = fit(x[order], y[order], Sparse(row[by_row], sparse.column[by_row], sparse.value[by_row], sparse.shape))
    return model and model | {"words": words}


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value)
        for batch in (part for whole in batches for part in rows_of(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(id, held_out, score, predicted)."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, whole=whole)
    return score(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", whole: bool = False) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns: rows pass through the scorer whole."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col, whole=whole))
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(model.value)
        for batch in (part for whole in batches for part in rows_of(whole)):
            yield batch.filter(pa.array(scorer.scores(batch.column(at).to_pylist()) >= CUT))

    return docs.mapInArrow(run, docs.schema)
