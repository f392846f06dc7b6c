"""The classifiers: held-out accuracy, bounds of scores, defined results for odd rows; the pipeline's stages."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from bookflow.llm import quality, toxicity
from bookflow.llm.common import table
from bookflow.llm.labelled import SAMPLE_ROWS, training_rows
from bookflow.llm.telling import Sparse
from tests.llm.helpers import DATA, ROWS, documents, empty

LARGE = "/root/testdata/sf0.1"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_quality_on_held_out_rows(spark):
    docs, marks = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    rows = quality.classify(docs, marks).filter("held_out").join(marks, "doc_id").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.97
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert np.mean([(good > b).mean() for b in bad]) > 0.97
    assert rows.score.between(0, 1).all()


def test_toxicity_on_held_out_rows(spark):
    docs, marks = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    rows = toxicity.classify(docs, marks).filter("held_out").join(marks.withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    flagged = rows[rows.toxic == 1]
    assert flagged.truth.mean() > 0.95
    assert rows[rows.truth == 1].toxic.mean() > 0.85
    assert rows.severity.between(0, 3).all()


def test_held_out_rows_never_train(spark):
    docs, marks = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    sample, _ = training_rows(docs, marks, "quality", 30)
    ids = [r.id for r in sample.collect()]
    assert 0 < len(ids) <= 30 < SAMPLE_ROWS and all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_labels_dont_depend_on_held_out_marks(spark):
    docs, marks = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    from pyspark.sql import functions as F

    turned = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.classify(docs, marks).collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs, turned).collect()}
    assert a == pytest.approx(b)


@pytest.mark.parametrize("marks", [[], [(1, 1, 0, "x"), (2, None, None, None), (None, 0, 1, "x"), (3, 7, 7, "x")], [(1, 1, 0, "a"), (2, 0, 1, "b"), (2, 1, 1, "b"), (4, 0, 1, "c")]])
def test_odd_rows(spark, marks):
    for found in (quality.classify(documents(spark), labels(spark, marks)), toxicity.classify(documents(spark), labels(spark, marks))):
        rows = found.collect()
        assert len(rows) == len(ROWS)
        assert len({r for r in rows if r.doc_id == 12}) == 1
        assert all(r.held_out is not None for r in rows)
    assert quality.classify(empty(spark), labels(spark, marks)).count() == 0
    assert toxicity.classify(empty(spark), labels(spark, marks)).count() == 0
    for keep in (quality.keep_good, toxicity.keep_clean):
        kept = keep(documents(spark), labels(spark, marks))
        assert kept.schema == documents(spark).schema and kept.count() <= len(ROWS)


def test_without_labels_all_stay(spark):
    none = labels(spark, [])
    assert {r.score for r in quality.classify(documents(spark), none).collect()} == {0.5}
    assert quality.keep_good(documents(spark), none).count() == toxicity.keep_clean(documents(spark), none).count() == len(ROWS)


def test_shared_features_are_told_apart():
    ranked = [("idiot", 0, 9), ("idio+", 0, 9), ("mean+", 1, 8), ("means", 0, 5)]
    assert toxicity.distinct_features(ranked) == ["idiot", "mean+", "means"]


def test_ordinal_fit_orders_severity():
    rng = np.random.default_rng(0)
    x = rng.poisson(0.5, (800, 3)).astype(float)
    grade = np.clip((x[:, 0] + x[:, 1] + rng.random(800) * 0.4).astype(int), 0, 3)
    weights, cuts = toxicity.fit(Sparse.of(x), grade)
    assert (weights >= 0).all() and weights[2] < 0.2 * weights[0] and (np.diff(cuts) >= 0).all()


def plain_telling(rows, features_of, either):
    """The likelihood-ratio test in plain Python: features and their counts by label."""
    n = [sum(y == k for y, _ in rows) for k in (0, 1)]
    seen = {}
    for y, text in rows:
        for f in features_of(text):
            seen.setdefault(f, [0, 0])[y] += 1
    seen = {f: c for f, c in seen.items() if sum(c) >= 4}
    passed = {}
    for f, c in seen.items():
        expected = [sum(c) * k / sum(n) for k in n]
        g = 2 * sum(o * np.log(o / e) for o, e in zip(c, expected) if o)
        if g >= 2 * np.log(max(2, len(seen)) / 0.05) and (either or c[1] > expected[1] and 2 * c[1] >= sum(c)):
            passed[f] = c
    return passed


def test_quality_equals_a_plain_refit(spark):
    """Words, pair differences and Newton steps written out with dense matrices give the query's scores."""
    docs, marks = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    sample, _ = training_rows(docs, marks, "quality")
    rows = sorted((r.id, r.label, r.text) for r in sample.collect())
    y = np.array([r[1] for r in rows])
    words = sorted(plain_telling([r[1:] for r in rows], lambda t: set(t.split()), True))
    share = lambda t: [np.log1p(100 * t.split().count(w) / max(1, len(t.split()))) for w in words]
    x = np.array([quality.features(r[2]) for r in rows])
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    knots = np.quantile(np.clip((x - mean) / std, -6, 6), quality.KNOTS, axis=0)

    def row(text):
        z = np.clip((np.array(quality.features(text)) - mean) / std, -6, 6)
        return np.concatenate([z, *(np.maximum(0, z - k) for k in knots), share(text)])

    b = np.array([row(r[2]) for r in rows])
    rng = np.random.default_rng(7)
    left, right = rng.choice(np.flatnonzero(y == 1), quality.PAIRS), rng.choice(np.flatnonzero(y == 0), quality.PAIRS)
    d = b[left] - b[right]
    ridge = np.r_[np.full(b.shape[1] - len(words), quality.RIDGE), np.full(len(words), quality.SPARSE_RIDGE)]
    w = np.zeros(b.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(d @ w))
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + np.diag(ridge), ridge * w - (d * p[:, None]).mean(axis=0))
    raw = b @ w
    cut = np.quantile(raw, (y == 0).mean())
    got = {r.doc_id: r.score for r in quality.classify(docs, marks).collect()}
    for r in docs.collect():
        want = 1 / (1 + np.exp(-(row(r.text or "") @ w - cut) * 2 / raw.std() - np.log(0.3 / 0.7)))
        assert got[r.doc_id] == pytest.approx(want, abs=5e-3)


def insulted(spark):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for k in range(900):
        words = [f"w{rng.integers(200)}" for _ in range(rng.integers(5, 60))]
        bad = rng.random() < 0.25
        for _ in range(rng.integers(1, 9) if bad else 0):
            words[rng.integers(len(words))] = rng.choice(["foulish", "rottened", "vile"])
        rows.append((k, " ".join(words)))
        marks.append((k, int(bad != (rng.random() < 0.02))))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"), rows, dict(marks)


def test_severity_equals_plain_scoring_of_an_optimal_model(spark):
    """The model is at the optimum of the likelihood written out; each document's severity follows from it by hand."""
    docs, labels_, rows, marks = insulted(spark)
    model = toxicity.train(docs, labels_)
    train = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 5]
    features = toxicity.distinct_features([(f, *c) for f, c in plain_telling([(marks[k], t) for k, t in train], toxicity.text_features, False).items()])
    assert set(model["features"]) == set(features) and {"foulish", "rottened", "vile"} <= set(features)
    number = {f: k for k, f in enumerate(model["features"])}

    def counted(words):
        x = np.zeros(len(number))
        for w in words:
            for f in toxicity.word_features(w):
                if f in number:
                    x[number[f]] += 1
        return np.log1p(x)

    parts = [(label, t.split()[half::2], t.split()[1 - half :: 2]) for k, t in train for half in (0, 1) for label in (marks[k],)]
    x = np.array([counted(own) for _, own, _ in parts])
    hits = np.array([sum(any(f in number for f in toxicity.word_features(w)) for w in other) for *_, other in parts])
    toxic = np.array([label for label, *_ in parts])
    low, high = np.quantile(hits[(toxic == 1) & (hits > 0)], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + np.where(hits > 0, (hits > low).astype(int) + (hits > high), 0), 0)

    def loss(w, cuts):
        above = np.c_[np.ones(len(x)), 1 / (1 + np.exp(-((x @ w)[:, None] - cuts))), np.zeros(len(x))]
        return -np.log(above[np.arange(len(x)), grade] - above[np.arange(len(x)), grade + 1]).mean() + 0.5e-5 * w @ w

    w, cuts = model["weights"], model["cuts"]
    slope = lambda f, v, k: (f(v + 1e-5 * np.eye(len(v))[k]) - f(v - 1e-5 * np.eye(len(v))[k])) / 2e-5
    for k in range(len(w)):
        g = slope(lambda v: loss(v, cuts), w, k)
        assert abs(g) < 2e-3 if w[k] > 0 else g > -2e-3
    assert all(abs(slope(lambda v: loss(w, v), cuts, k)) < 2e-3 for k in range(3))
    whole = {k: counted(t.split()) @ w for k, t in rows}
    errors = lambda cut: sum((whole[k] >= cut) != marks[k] for k, _ in train)
    values = sorted({whole[k] for k, _ in train})
    assert errors(model["toxic_from"]) == min(map(errors, [v for v in values if v > 0] + [values[-1] + 1]))
    got = {r.doc_id: r for r in toxicity.classify(docs, labels_).collect()}
    for k, text in rows:
        p = [1 / (1 + np.exp(-(counted(text.split()[half::2]) @ w - cuts))) for half in (0, 1)]
        assert got[k].severity == pytest.approx((p[0].sum() + p[1].sum()) / 2, abs=1e-9) and got[k].toxic == (whole[k] >= model["toxic_from"])


def test_severity_meets_the_grades(spark):
    """Over rows that never trained, the mean severity is the mean grade made in the same way."""
    docs, labels_, rows, marks = insulted(spark)
    model = toxicity.train(docs, labels_)
    counting = toxicity.Counting(model["features"])
    hits = {k: [h for *_, h in toxicity.graded(counting, t)] for k, t in rows}
    trained = [h for k, _ in rows if zlib.crc32(str(k).encode()) % 5 and marks[k] for h in hits[k] if h]
    low, high = np.quantile(trained, [1 / 3, 2 / 3])
    grade = {k: np.mean([marks[k] * (1 + (h > low) + (h > high)) for h in hits[k]]) for k, _ in rows}
    for held in (True, False):
        found = {r.doc_id: r.severity for r in toxicity.classify(docs, labels_).collect() if r.held_out == held}
        assert np.mean(list(found.values())) == pytest.approx(np.mean([grade[k] for k in found]), rel=0.2 if held else 0.05)  # 180 and 720 rows


def test_of_texts_that_share_an_id_the_greatest_trains(spark):
    docs = spark.createDataFrame([(k, t) for k in range(60) for t in (f"a{k}", f"b{k}", None)], "doc_id long, text string").repartition(7)
    sample, _ = training_rows(docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int"), "toxic")
    assert {r.text for r in sample.collect()} == {f"b{k}" for k in range(60) if zlib.crc32(str(k).encode()) % 5}


def test_no_telling_feature_is_left_out(spark):
    """More telling words than any fixed number of features would hold."""
    rows = [(k, " ".join(f"{'bad' if k % 2 else 'good'}{(k // 2 * 60 + n) % 1500:04d}" for n in range(300))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int"))["features"]
    assert {f"bad{n:04d}" for n in range(1500)} <= set(found)


def test_pipeline_equals_its_operators(spark):
    import corpus_pipeline
    from bookflow.llm import packing
    from tests.llm.helpers import components, tokenizer_json
    from tests.llm.test_tokens import check_packing
    from tests.llm.helpers import library_ids

    docs, marks = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.classify(docs, marks).filter("toxic = 1").collect()}
    clean = docs.filter(~docs.doc_id.isin(sorted(toxic))) if toxic else docs
    bad = {r.doc_id for r in quality.classify(clean, marks).filter("predicted = 0").collect()}
    left = sorted(set(rows) - toxic - bad)
    last = {}
    for d in left:
        last[rows[d].text] = d
    unique = sorted(last.values())
    label = components((d, rows[d].text) for d in unique)
    final = [d for d in unique if label[d] == d]
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in packed} == set(final)
    check_packing(packed, [(d, np.append(x, np.uint32(1))) for d, x in zip(final, library_ids(rows[d].text for d in final))])
    assert packing.SCHEMA and tokenizer_json()


def test_stages_on_odd_and_empty_tables(spark):
    import corpus_pipeline

    for docs in (documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            if name != "packing":
                assert out.columns == docs.columns
            out.count()
