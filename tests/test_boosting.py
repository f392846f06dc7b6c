"""Softmax boosting from a binned store against trees grown in memory, and its state."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.operators import binned, boosting
from bookflow.operators.boosting import Booster, Options
from bookflow.operators.model import DirectionModel

N, WIDTH = 2400, 5


def rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(N, WIDTH)).astype(np.float32).round(2)
    x[::97, 3] = np.nan
    y = np.where(x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0.5, 2, np.where(x[:, 0] - x[:, 4] ** 2 < -1, 0, 1))
    y = np.where(rng.random(N) < 0.1, rng.integers(0, 3, N), y)
    return x, y, rng.normal(size=N) / 100, np.arange(N) % 4 == 0


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    x, y, move, validation = rows()
    df = spark.createDataFrame([(x[i].tolist(), int(y[i]), float(move[i]), bool(validation[i]), "x") for i in range(N)], "features array<float>, label int, price_diff double, validation boolean, extra string").repartition(5)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(binned, "ACCURACY", 1000)  # the sketch holds all values of the fixture
        return binned.write(df, f"{tmp_path_factory.mktemp('store')}/s", "print", max_bin=32), df


def test_bins_equal_numpys(store):
    x, y, move, validation = rows()
    made, _ = store
    for f, cuts in enumerate(made.cuts):
        known = x[~validation, f][~np.isnan(x[~validation, f])]
        assert np.array_equal(cuts, np.unique(np.quantile(known, [k / 32 for k in range(1, 32)], method="inverted_cdf").astype(np.float32)))
    want = sorted((bool(v), int(label), round(float(m), 9), bytes(0 if np.isnan(a) else int((cuts < a).sum()) for a, cuts in zip(r, made.cuts))) for r, label, m, v in zip(x, y, move, validation))
    assert sorted((r.validation, r.label, round(r.price_diff, 9), bytes(r.bins)) for r in made.rows.collect()) == want
    assert made.counts() == [int((y[~validation] == k).sum()) for k in range(3)]
    assert made.manifest["mean_move"] == pytest.approx(np.abs(move[~validation]).mean())


def test_a_store_is_reused_for_the_same_inputs_only(spark, store):
    made, _ = store
    assert binned.find(spark, made.path, "print").manifest == made.manifest
    assert binned.find(spark, made.path, "another") is None and binned.find(spark, f"{made.path}-none", "print") is None


def plain(x, y, weight, validation, o, cuts):
    """Trees by direct search over values; every row and feature."""
    f, trees, losses = np.zeros((len(x), 3)), [], []
    held = lambda g: np.sign(g) * max(abs(g) - o.lasso, 0)
    score = lambda g, h: held(g) ** 2 / (h + o.ridge)

    def grow(at, g, h, depth):
        leaf = -o.rate * held(g[at].sum()) / (h[at].sum() + o.ridge)
        best = (o.least_gain, None)
        if depth:
            for k in range(x.shape[1]):
                for c in cuts[k][: 31 if len(cuts[k]) > 31 else None]:
                    left = at[~(x[at, k] > c)]
                    right = at[x[at, k] > c]
                    if h[left].sum() >= o.least_hessian and h[right].sum() >= o.least_hessian:
                        gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[at].sum(), h[at].sum())
                        if gain > best[0] + 1e-9:
                            best = gain, (k, c, left, right)
        if best[1] is None:
            return leaf
        k, c, left, right = best[1]
        return k, c, grow(left, g, h, depth - 1), grow(right, g, h, depth - 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
        return tree

    train = np.flatnonzero(~validation)
    for _ in range(o.rounds):
        p = np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)
        losses.append(-(np.log(p[validation, y[validation]]) * weight[validation]).sum() / weight[validation].sum())
        own = [grow(train, (p[:, c] - (y == c)) * weight, 2 * p[:, c] * (1 - p[:, c]) * weight, o.depth) for c in range(3)]
        f = f + np.array([[value(t, r) for t in own] for r in x])
        trees.append(own)
    return f, losses


def test_rounds_equal_plain_trees(store):
    """Gradients of three classes, class weights, penalties, splits and losses, worked out by hand."""
    x, y, _, validation = rows()
    made, df = store
    o = Options(rounds=3, depth=2, rate=0.4, least_hessian=3, rows=1, columns=1, lasso=0.5, patience=50)
    fitted = Booster(o).fit(made)
    counts = np.array(made.counts())
    f, losses = plain(x, y, (counts.sum() / (3 * counts))[y], validation, o, made.cuts)
    assert np.allclose(fitted.losses[:3], losses, atol=1e-6)
    whole = fitted if len(fitted.rounds) == 3 else Booster(o, fitted.rounds)
    got = whole.score(df.withColumn("key", F.concat_ws(",", F.transform("features", lambda v: v.cast("string")))))
    p = np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)
    want = {tuple(np.nan_to_num(r, nan=-9).tolist()): q for r, q in zip(x, p)}
    for r in got.collect():
        assert np.allclose([r.down, r.flat, r.up], want[tuple(np.nan_to_num(np.array(r.features, np.float32), nan=-9).tolist())], atol=1e-6)


def test_stops_and_resumes_to_the_same_trees(spark, store, tmp_path, monkeypatch):
    made, df = store
    o = Options(rounds=12, patience=6, depth=2, rate=0.5, least_hessian=5, lasso=0, save_every=5, seed=3)
    whole = Booster(o).fit(made)
    Booster(o).fit(made, f"{tmp_path}/state", stop_after=8)
    assert boosting.saved_rounds(spark, f"{tmp_path}/state") == [5]
    monkeypatch.setattr(boosting, "REFRESH", 3)  # another rhythm of writing margins and smaller jobs change nothing
    monkeypatch.setattr(boosting, "HISTOGRAM_BYTES", 1)
    monkeypatch.setattr(boosting, "SLICE", 1)
    again = Booster(o).fit(made, f"{tmp_path}/state")
    assert whole.losses == again.losses and len(whole.rounds) == len(again.rounds)
    for a, b in zip(whole.rounds, again.rounds):
        for s, t in zip(a, b):
            assert np.array_equal(s.feature, t.feature) and np.array_equal(s.cut, t.cut) and np.array_equal(s.leaf, t.leaf)
    assert len(whole.rounds) == int(np.argmin(whole.losses)) and len(whole.losses) <= len(whole.rounds) + 7
    DirectionModel(kind="softmax", fitted=whole).save(f"{tmp_path}/model")
    back = DirectionModel.load(f"{tmp_path}/model", "softmax")
    columns = ["down", "flat", "up"]
    assert back.rounds() == [len(whole.rounds)] * 3 and back.fitted.options == o
    assert sorted(map(tuple, back.score(df).select(*columns).collect())) == sorted(map(tuple, whole.score(df).select(*columns).collect()))
    assert {n for n, _ in back.importances(list("abcde"))[:2]} <= {"a", "b", "e"}


def test_one_sequence_beats_three(spark, store):
    """The loss over validation rows is below that of one-against-rest boosters of as many rounds and depth."""
    made, df = store
    loss = lambda scored: scored.filter("validation").select(F.avg(-F.log(F.greatest(F.element_at(F.array("down", "flat", "up"), F.col("label") + 1), F.lit(1e-15))))).first()[0]
    ours = Booster(Options(rounds=20, patience=20, depth=3, rate=0.3, least_hessian=2, least_gain=0, lasso=0, rows=1, columns=1, class_weights=False)).fit(made)
    clean = df.withColumn("features", F.transform("features", lambda v: F.nanvl(v, F.lit(0.0).cast("float")))).withColumn("label", F.col("label").cast("double")).withColumn("weight", F.lit(1.0))
    theirs = DirectionModel(kind="boosted", options={"maxIter": 20, "maxDepth": 3, "stepSize": 0.3}).fit(clean, "validation")
    assert loss(ours.score(df)) < loss(theirs.score(clean).withColumn("label", F.col("label").cast("int")))


def test_odd_stores(spark, tmp_path):
    none = spark.createDataFrame([], "features array<float>, label int, price_diff double, validation boolean")
    with pytest.raises(ValueError, match="no samples"):
        binned.write(none, f"{tmp_path}/none")
    same = spark.createDataFrame([([1.0, None], k % 2, None, False) for k in range(40)] + [([2.0, 1.0], None, 0.0, False), ([2.0, 1.0], 7, 0.0, True)], "features array<float>, label int, price_diff double, validation boolean")
    made = binned.write(same, f"{tmp_path}/same")
    assert made.manifest["counts"] == {"train": [20, 20, 0], "validation": [0, 0, 0]} and [len(c) for c in made.cuts] == [1, 0]
    fitted = Booster(Options(rounds=2, depth=2, least_hessian=0.1, lasso=0, rows=1, columns=1)).fit(made)
    assert len(fitted.rounds) == 2 and np.isnan(fitted.losses).all()  # no validation rows: no early end
    assert json.dumps(fitted.options.profit) == "null" and fitted.score(same).count() == 42


def test_profit_weights_follow_training_rows(store):
    made, _ = store
    weight = Booster(Options(profit=(0.5, 1.5, 0.1, 2.0)))._weights(made)
    counts, move = np.array(made.counts()), made.manifest["mean_move"]
    label, diff = np.array([0, 2, 1]), np.array([0.0, 10.0, -move])
    want = counts.sum() / (3 * counts)[label] * np.array([0.5, 2.0, 1.0])  # the last one validates
    assert np.allclose(weight(label, diff, np.array([False, False, True])), want)


def test_rows_between_rounds_are_blocks(spark, store, monkeypatch):
    """a pass of a level takes a record a block of rows, training rows alone where no loss is asked for; sizes change no tree."""
    made, _ = store
    o = Options(rounds=3, depth=2, rate=0.4, least_hessian=3, patience=50)
    table, _ = Booster(o)._margins(made, made.rows, [])
    flags = [r.validation for r in table.select("validation").collect()]
    assert len(flags) <= 2 * made.rows.rdd.getNumPartitions() and set(flags) == {False, True}
    whole = Booster(o).fit(made)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    monkeypatch.setattr(boosting, "REFRESH", 1)
    small = Booster(o).fit(made)
    assert whole.losses == small.losses
    assert all(np.array_equal(s.leaf, t.leaf) for a, b in zip(whole.rounds, small.rounds) for s, t in zip(a, b))


def test_softmax_samples_are_made_once(spark, monkeypatch):
    """the book is read for one table of samples, which all passes read."""
    from bookflow import queries_live

    passes, read = [], queries_live.binned.write
    monkeypatch.setattr(queries_live.binned, "write", lambda made, path: passes.append(made) or read(made, path))
    queries_live.softmax_predict(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in passes[0].inputFiles()[0] and "Window" not in passes[0]._jdf.queryExecution().toString()
