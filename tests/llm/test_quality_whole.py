"""The quality model of all training rows and all pairs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from bookflow.llm import quality
from bookflow.llm.common import table
from bookflow.llm.labelled import training_rows
from tests.llm.helpers import DATA, ROWS, documents
from tests.llm.test_learned import labels, plain_telling


def test_all_pairs_of_all_rows_are_fitted(spark):
    """Every pair listed, dense matrices and Newton steps: the same scores. Drawn pairs are off by 0.009 here."""
    docs, marks = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    sample, _ = training_rows(docs, marks, "quality", None)
    rows = sorted((r.id, r.label, r.text) for r in sample.collect())
    y = np.array([r[1] for r in rows])
    assert not plain_telling([r[1:] for r in rows], lambda t: set(t.split()), True)
    x = np.array([quality.features(r[2]) for r in rows])
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    ranks = np.ceil(np.array(quality.KNOTS) * len(x)).astype(int) - 1
    model = {"mean": mean, "std": std, "knots": np.clip((np.sort(x, axis=0)[ranks] - mean) / std, -6, 6)}
    b = quality.basis(x, model)
    d = (b[y == 1][:, None] - b[y == 0]).reshape(-1, b.shape[1])
    w = np.zeros(b.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(d @ w))
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(len(w)), quality.RIDGE * w - (d * p[:, None]).mean(axis=0))
    raw = b @ w
    cut = np.quantile(raw, (y == 0).mean())
    got = {r.doc_id: r.score for r in quality.classify(docs, marks, whole=True).collect()}
    for r in docs.collect():
        want = 1 / (1 + np.exp(-((quality.basis(np.array([quality.features(r.text or "")]), model) @ w)[0] - cut) * 2 / raw.std() - np.log(0.3 / 0.7)))
        assert got[r.doc_id] == pytest.approx(want, abs=2e-3)


@pytest.mark.parametrize("marks", [[], [(1, 1, 0, "a"), (2, 0, 1, "b"), (2, 1, 1, "b"), (4, 0, 1, "c")]])
def test_equal_texts_have_equal_scores(spark, marks):
    rows = quality.classify(documents(spark).repartition(3), labels(spark, marks), whole=True).collect()
    assert len(rows) == len(ROWS) and len({r for r in rows if r.doc_id == 12}) == 1


def test_rows_beyond_the_bounded_sample_train(spark):
    docs, marks = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    assert training_rows(docs, marks, "quality", 30)[0].count() == 30 < training_rows(docs, marks, "quality", None)[0].count() == 68


def test_texts_measured_together_are_as_alone():
    texts = [r[1] or "" for r in ROWS] + ["a\nb\na\nb\n", "x. y!\x1cz?", "no. NO. A", "||!! http://x"]
    number = {"same": 2, "lorem": 0, "ipsum": 1, "word3": 3}
    x, sparse = quality.measured(texts, number)
    for k, text in enumerate(texts):
        words = text.split()
        assert x[k].tolist() == quality.features(text)
        assert x[k][11] == len(set(words)) / max(1, len(words)) and x[k][15] == len(set(zip(words, words[1:]))) / max(1, len(words))
        assert x[k][22] == len(re.findall(r"[.!?](?:\s|$)", text)) / max(1, len(words)) and x[k][23] == sum(w.isupper() and len(w) > 1 for w in words) / max(1, len(words))
        found = {number[w]: np.log1p(100 * words.count(w) / len(words)) for w in number if w in words}
        assert dict(zip(sparse.column[sparse.row == k].tolist(), sparse.value[sparse.row == k].tolist())) == pytest.approx(found)


def test_steps_read_blocks_and_seldom_sum_the_curvature(spark, monkeypatch):
    """A step reads a row per block of documents, not a value at a time, and most steps sum a number a feature only."""
    sample, _ = training_rows(table(spark, DATA, "documents"), table(spark, DATA, "labels"), "quality", None)
    blocks = quality.examples(sample.coalesce(1), ["a"])
    held = blocks.toArrow()
    assert held.num_rows == 1 and set(held.schema.types) == {pa.binary()}
    sizes = []
    monkeypatch.setattr(quality, "summed", lambda rows, width, of, size: sizes.append(size) or of(*quality.arrays(held, width)))
    quality.fit_whole(blocks.drop("id"), 1, steps=8)
    slopes = [s for s in sizes if s not in (2, 4 * len(quality.GRID))]
    assert len(slopes) > 4 and sum(s > 1000 for s in slopes) <= 1 + len(slopes) // 4
