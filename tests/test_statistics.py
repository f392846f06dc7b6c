"""Exact percentiles against numpy, windows on their own, boosted trees, field groups of files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.functions import windows as w
from bookflow.operators import evaluate, model, profile, samples
from bookflow.operators.quantile import exact_percentiles
from bookflow.sources import snapshots

FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 9 + [7.0], [float(k % 3) for k in range(100)], [k * 0.37 % 11 - 4 for k in range(5001)], [None, 2.0, None, -1.0]])
def test_percentiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    found = exact_percentiles(df, "x", FRACTIONS).first().at
    assert found == pytest.approx(np.quantile([v for v in values if v is not None], FRACTIONS).tolist(), abs=1e-12)


def test_percentiles_of_many_values(spark):
    """More values than the sketch keeps; a third of all rows share one."""
    df = spark.range(600_000).select(F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.abs(F.xxhash64("id") % 1_000_003) / 1_000_003).alias("x"))
    plain = df.select(F.percentile("x", F.array(*map(F.lit, FRACTIONS)))).first()[0]
    assert exact_percentiles(df, "x", FRACTIONS).first().at == pytest.approx(plain, abs=1e-12)


def test_nothing_to_rank(spark):
    empty = spark.createDataFrame([], "x double, pnl double")
    assert exact_percentiles(empty, "x", [0.1, 0.9]).first().at == [None, None]
    assert profile.clipped(empty, "x").count() == 0
    assert profile.describe_column(empty, "x").first().median is None
    assert evaluate.pnl_stats(empty).first().asDict()["n"] == 0


def test_users_keep_their_columns(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"), F.lit("a").alias("at"))
    kept = profile.clipped(df, "x", 0.1, 0.9)
    assert kept.columns == ["x", "at"] and sorted(r.x for r in kept.collect()) == [float(k) for k in range(10, 91)]
    assert profile.describe_column(df, "x").first().median == 50


@pytest.mark.parametrize("length,stride", [(4, 1), (4, 3), (4, 4), (2, 5), (30, 1)])
def test_lone_windows(spark, length, stride):
    """Each window of each group, whole, counted anew; groups too short for one have none."""
    sizes = {1: 11, 2: 4, 3: 3, 4: 29}
    rows = [(sym, 5, sym % 2, nr, float(100 * sym + nr)) for sym, n in sizes.items() for nr in range(1, n + 1)]
    ticks = spark.createDataFrame(rows, "sym int, date int, session int, row_nr int, x double").repartition(3)
    got = samples.lone_windows(ticks, length, stride)
    held = {}
    for r in got.collect():
        held.setdefault((r.sym, r.session, r.window_end), {})[r.row_nr] = r.x
    wanted = {}
    for sym, n in sizes.items():
        for end in range(length - 1, n, stride):
            wanted[sym, (sym % 2) * 2**40 + end, end] = {k + 1: float(100 * sym + end - length + 2 + k) for k in range(length)}
    assert held == wanted


def test_lone_windows_see_nothing_outside(spark):
    ticks = spark.range(1, 251).selectExpr("1 AS sym", "0 AS date", "0 AS session", "CAST(id AS INT) AS row_nr", "CAST(id AS DOUBLE) AS x")
    seen = samples.lone_windows(ticks, 100, 50).selectExpr("window_end", "row_nr", f"{w.clamped('x', 20)} AS back", f"{w.rolling('avg', 'x', 60)} AS mean")
    first = {r.window_end: (r.back, r.mean) for r in seen.filter("row_nr = 1").collect()}
    assert first == {end: (end - 98.0, end - 98.0) for end in (99, 149, 199, 249)}


def test_boosted_trees_stop_early(spark, tmp_path):
    rows = spark.range(400).selectExpr("array(CAST(id % 3 AS FLOAT), CAST(id % 7 AS FLOAT)) AS features", "CAST(CASE WHEN id % 11 = 0 THEN (id + 1) % 3 ELSE id % 3 END AS DOUBLE) AS label", "1D AS weight", "id", "id % 4 = 0 AS val")
    options = {"maxIter": 6, "maxDepth": 2}
    stopped = model.DirectionModel(kind="boosted", options=options).fit(rows, "val")
    assert all(1 <= k <= 6 for k in stopped.rounds()) and model.DirectionModel(kind="boosted", options={**options, "maxIter": 2}).fit(rows).rounds() == [2, 2, 2]
    stopped.save(str(tmp_path / "m"))
    again = model.DirectionModel.load(str(tmp_path / "m"), "boosted")
    scored = again.score(rows).orderBy("id").collect()
    assert scored == stopped.score(rows).orderBy("id").collect()
    assert scored[0].asDict().keys() == {"features", "label", "weight", "id", "val", "down", "flat", "up"}
    assert all(abs(r.down + r.flat + r.up - 1) < 1e-9 for r in scored)
    assert sum(max((r.down, 0), (r.flat, 1), (r.up, 2))[1] == r.id % 3 for r in scored) > 390
    assert again.importances(["a", "b"])[0][0] == "a"


def test_field_groups_by_file(spark, tmp_path):
    for name, text in (("sym0_date0_am", "time,n_bid1,label5\n1,2,0\n"), ("sym0_date0_pm", "time,n_midprice,amount_delta,n_ask2,label_10\n"), ("sym1_date0_am", "")):
        (tmp_path / f"snapshot_{name}.csv").write_text(text)
    found = {r.source_file[9:-4]: r.missing_groups for r in snapshots.missing_field_groups_by_file(spark, str(tmp_path)).collect()}
    assert found == {"sym0_date0_am": ["volume", "mid"], "sym0_date0_pm": [], "sym1_date0_am": ["prices", "volume", "mid", "labels"]}


def test_compare_tables(spark):
    ours = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), "b"), (3, 3.0, "c")], "k int, x double, y string")
    theirs = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), "z"), (4, 3.0, "c")], "k int, x double, y string")
    found = {r["column"]: (r.equal, r.different, r.only_ours, r.only_theirs) for r in profile.compare_tables(ours, theirs, ["k"]).collect()}
    assert found == {"x": (2, 0, 1, 1), "y": (1, 1, 1, 1)}
    none = ours.limit(0)
    assert {tuple(r)[1:] for r in profile.compare_tables(none, none, ["k"]).collect()} == {(0, 0, 0, 0)}
