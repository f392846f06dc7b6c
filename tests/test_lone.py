"""Features of lone windows against copies of ticks, exact selection, candles of rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.operators import candles, evaluate, features_main, lone, quantile, samples, vector
from bookflow.plans.book import book

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("length, batch", [(100, 10_000), (40, 23)])
def test_lone_windows_equal_copies(spark, length, batch):
    """Every window of every group, whatever the size of a batch, gaps in prices too, with all 922 values."""
    ticks = book(spark, DATA, long=True).filter("sym < 3 AND row_nr <= 240").withColumn("n_midprice", F.when(F.col("row_nr") % 37 != 0, F.col("n_midprice")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.sym, r.row_nr): r.vector for r in lone.window_vectors(ticks, length).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    copies = samples.lone_windows(ticks, length, 1)
    featured = vector.pyramid(features_main.features(copies), features_main.FEATURES).filter(f"row_nr = {length}")
    want = {(r.sym, r.window_end + 1): r.vector for r in featured.select("sym", "window_end", "vector").collect()}
    assert got.keys() == want.keys() and len(got) > 250
    assert np.allclose(np.array([got[k] for k in sorted(got)]), np.array([want[k] for k in sorted(got)]), rtol=1e-5, atol=1e-7)


def test_rows_shuffled_dont_grow_with_the_window(spark):
    ticks = book(spark, DATA, long=True)
    plans = [lone.window_vectors(ticks, length)._jdf.queryExecution().executedPlan().toString() for length in (30, 300)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") <= 3 and not any("explode" in p for p in plans)


def brute(rows, percent):
    sides = {}
    for side, v in rows:
        if v is not None:
            sides.setdefault(str(side), []).append(v)
            sides.setdefault("all", []).append(v)
    out = {}
    for side, values in sides.items():
        best = sorted(values, reverse=True)[: max(math.floor(len(values) * percent / 100), 1)]
        out[side] = (len(best), sum(best), min(best), max(best))
    return out


@pytest.mark.parametrize("ordered", [2, 100_000])
@pytest.mark.parametrize("percent", [0.01, 61.8, 100.0])
def test_top_percent(spark, monkeypatch, ordered, percent):
    monkeypatch.setattr(quantile, "ORDERED", ordered)
    rng = np.random.default_rng(int(percent * 10) + ordered)
    rows = [(0, float(v)) for v in rng.normal(size=3000)] + [(2, float(v)) for v in rng.integers(-3, 3, 2000)] + [(1, 5.5)] * 700 + [(4, 1e9), (4, -1e9), (4, 1e-300), (2, None), (0, 0.1), (0, 0.1)]
    got = evaluate.top_percent(spark.createDataFrame(rows, "signal int, pnl double").repartition(5), percent).collect()
    want = brute(rows, percent)
    assert {r.side for r in got} == set(want)
    for r in got:
        n, total, low, high = want[r.side]
        assert (r.trades, r.low, r.high) == (n, low, high) and r.total == pytest.approx(total, rel=1e-9, abs=1e-9) and r.mean == pytest.approx(total / n, rel=1e-9, abs=1e-9)


def test_no_more_values_are_ordered_than_allowed(spark, monkeypatch):
    """A continuous column of 300,000 values: what is put in order stays under the bound."""
    monkeypatch.setattr(quantile, "ORDERED", 1_000)
    df = spark.range(300_000).select(F.lit(1).alias("signal"), F.randn(3).alias("pnl"))
    seen = []
    kept = quantile._ends
    monkeypatch.setattr(quantile, "_ends", lambda held: seen.append(rows := kept(held)) or rows)
    got = {r.side: r for r in evaluate.top_percent(df, 10.0).collect()}
    values = np.sort(df.toPandas()["pnl"])[::-1][:30_000]
    assert got["1"].low == got["all"].low == values[-1] and got["1"].total == pytest.approx(values.sum())
    assert len(seen) == 1 and len(seen[0]) <= 2 * 1_100
    none = evaluate.top_percent(df.filter("false"), 10.0)
    assert none.count() == 0


def test_candles_of_rows(spark):
    """Uneven candles with a gap, overlapping ones and rows of no candle."""
    times = [0, 1, 2, 31, 32, 33, 34, 35, 200, 201, 395, 399]
    ticks = spark.createDataFrame([(s, 0, 0, k + 1, t + s, float(t), 1.0, "x") for s in (1, 2) for k, t in enumerate(times)], "sym int, date int, session int, row_nr int, tod int, n_midprice double, amount_delta double, extra string")
    found = candles.numbered(candles.candles(ticks, 30))
    for width in (1, 3, 4096):
        got = {(r.sym, r.row_nr): r.candle_idx for r in candles.of_rows(ticks, found, width).collect()}
        for s in (1, 2):
            buckets = sorted({(t + s) // 30 for t in times})
            assert [got[s, k + 1] for k in range(len(times))] == [buckets.index((t + s) // 30) for t in times]
    approximate = ticks.selectExpr("sym", "row_nr", f"{candles.approximate_candle(30)} AS c").collect()
    assert {(r.sym, r.row_nr): r.c for r in approximate} != got
    other = spark.createDataFrame([(1, 0, 0, 2, 9, 0), (1, 0, 0, 4, 6, 1), (2, 0, 0, 50, 60, 0)], "sym int, date int, session int, row_start int, row_end int, candle_idx int")
    got = {(r.sym, r.row_nr): r.candle_idx for r in candles.of_rows(ticks, other, 4).collect()}
    assert [got[1, k] for k in range(1, 13)] == [None, None, 0, 0, 1, 1, 1, 0, 0, 0, None, None] and {got[2, k] for k in range(1, 13)} == {None}
    assert candles.of_rows(ticks, found, 3).columns == [*ticks.columns, "candle_idx"]
