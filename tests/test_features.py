"""The catalogues against pandas formulas written apart from them, and the edge rows that no driver table has."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bookflow.functions import exprs
from bookflow.operators import candles, evaluate, ewm, features_main, features_report, features_small, features_tabular, profile, samples, signals, vector
from bookflow.plans.book import book
from bookflow.schema import RAW

DATA = "/root/testdata/sf0.001"
EPS = 1e-10


@pytest.fixture(scope="module")
def ticks(spark):
    return book(spark, DATA, long=True).filter("sym <= 3").cache()


@pytest.fixture(scope="module")
def main(ticks):
    return features_main.features(ticks).toPandas().sort_values(["sym", "row_nr"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def raw(ticks):
    return ticks.toPandas().sort_values(["sym", "row_nr"]).reset_index(drop=True)


def test_counts():
    assert len(features_main.FEATURES) == len(set(features_main.FEATURES)) == 182
    assert len(features_tabular.FEATURES) == 207
    assert [len(features_report.feature_names(k)) for k in (5, 3)] == [163, 111]
    assert len(features_small.FEATURES) == 43
    assert len(vector.pyramid_names(features_main.FEATURES)) == 922


def each(raw, column, function):
    return raw.groupby("sym")[column].transform(function)


def near(got, expected, tolerance=1e-4):
    expected = pd.Series(np.asarray(expected, float)).replace([np.inf, -np.inf], np.nan).fillna(0).to_numpy()
    np.testing.assert_allclose(np.asarray(got, float), expected, rtol=tolerance, atol=tolerance)


def test_main_rolling(raw, main):
    m = raw.n_midprice
    near(main.close_mean, each(raw, "n_close", lambda x: x.rolling(10, min_periods=1).mean()))
    near(main.close_std, each(raw, "n_close", lambda x: x.rolling(10, min_periods=1).std()))
    for k in (20, 100, 300):
        mean, std = (each(raw, "n_midprice", lambda x, f=f: getattr(x.rolling(k, min_periods=1), f)()) for f in ("mean", "std"))
        near(main[f"price_zscore_{k}"], (m - mean) / (std + EPS))
        third, shift = k // 3, 2 * k // 3
        recent = each(raw, "n_midprice", lambda x: x.rolling(third, min_periods=1).mean())
        older = each(raw, "n_midprice", lambda x: x.shift(shift).rolling(third, min_periods=1).mean())
        near(main[f"price_slope_{k}"], (recent - older) / (shift + EPS))
    near(main.roc_10, (m / each(raw, "n_midprice", lambda x: x.shift(10)) - 1).fillna(0))
    low, high = (each(raw, "n_midprice", lambda x, f=f: getattr(x.rolling(100, min_periods=1), f)()) for f in ("min", "max"))
    near(main.price_percentile_100, (m - low) / (high - low + EPS))
    v5, v100 = (each(raw, "amount_delta", lambda x, k=k, f=f: getattr(x.rolling(k, min_periods=1), f)()) for k, f in ((5, "sum"), (100, "mean")))
    near(main.volume_flow_5, v5 / (v100 + EPS))
    std, mean = (each(raw, "amount_delta", lambda x, f=f: getattr(x.abs().rolling(20, min_periods=1), f)()) for f in ("std", "mean"))
    near(main.vpin_20, std.fillna(1e-10) / (mean + EPS))


def test_main_flow_and_nested(raw, main):
    def part(g):
        b, bs, a, s = g.n_bid1, g.n_bsize1, g.n_ask1, g.n_asize1
        bid = np.where(b > b.shift(), bs, np.where(b == b.shift(), bs - bs.shift(), -bs.shift()))
        ask = np.where(a < a.shift(), s, np.where(a == a.shift(), s - s.shift(), -s.shift()))
        return pd.Series(bid - ask, index=g.index).fillna(0)

    flow = pd.concat([part(g) for _, g in raw.groupby("sym")]).sort_index()
    near(main.ofi_1, flow)
    near(main.ofi_1_rolling_5, flow.groupby(raw.sym).transform(lambda x: x.rolling(5, min_periods=1).sum()))
    near(main.ofi_ema_5, flow.groupby(raw.sym).transform(lambda x: x.ewm(span=5, adjust=False).mean()))
    fall = each(raw, "n_midprice", lambda x: x.diff())
    near(main.midprice_accel, fall.groupby(raw.sym).diff().fillna(0))
    t = 2 + raw.n_ask1 + raw.n_bid1
    vol = (t / (t.groupby(raw.sym).shift(10) + EPS) - 1).fillna(0)
    near(main.vov_10, vol.groupby(raw.sym).transform(lambda x: x.rolling(5, min_periods=1).std()).fillna(0))


def test_main_recursive(raw, main):
    dif = each(raw, "n_midprice", lambda x: x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean())
    near(main.macd_dif, dif)
    near(main.macd_dea, dif.groupby(raw.sym).transform(lambda x: x.ewm(span=9, adjust=False).mean()))
    low, high = each(raw, "n_bid1", lambda x: x.rolling(9, min_periods=1).min()), each(raw, "n_ask1", lambda x: x.rolling(9, min_periods=1).max())
    k = (100 * (raw.n_midprice - low) / (high - low + EPS)).groupby(raw.sym).transform(lambda x: x.ewm(alpha=1 / 3, adjust=False).mean())
    near(main.kdj_k, k)


def test_tabular_windows(ticks, raw):
    got = features_tabular.features(ticks).toPandas().sort_values(["sym", "row_nr"]).reset_index(drop=True)
    for k in (5, 100):
        expected = each(raw, "n_midprice", lambda x: x.rolling(k).mean())
        assert (got[f"n_midprice_roll_{k}_mean"].isna() == expected.isna()).all()
        near(got[f"n_midprice_roll_{k}_mean"].fillna(0), expected.fillna(0))
        near(got[f"n_midprice_roll_{k}_change"].fillna(0), each(raw, "n_midprice", lambda x: x - x.shift(k - 1)).fillna(0))


def test_ewm_decays_through_gaps():
    x = np.array([1, np.nan, np.nan, 4, 5.0])
    np.testing.assert_allclose(ewm.ewm(x, 1 / 3), pd.Series(x).ewm(span=5, adjust=False).mean().to_numpy())
    np.testing.assert_allclose(ewm.ewm(np.array([np.nan, 2, 3.0]), 0.5), pd.Series([np.nan, 2, 3.0]).ewm(alpha=0.5, adjust=False).mean().to_numpy())


def test_smoothing_of_any_length(spark):
    """A group beyond a million ticks is smoothed to its end."""
    n = 1_000_300
    long_group = spark.range(n).selectExpr("1 AS sym", "0 AS date", "0 AS session", "CAST(id AS INT) AS row_nr", "CAST(id % 97 AS DOUBLE) AS n_midprice")
    last = ewm.smooth(long_group, "n_midprice", {"y": 0.25}).filter(F.col("row_nr") > n - 200).orderBy("row_nr").toPandas().y.to_numpy()
    want = pd.Series(np.arange(n) % 97).astype(float).ewm(alpha=0.25, adjust=False).mean().to_numpy()[-len(last) :]
    np.testing.assert_allclose(last, want, rtol=1e-12)


def test_vectors(spark, ticks, main):
    rows = vector.pyramid(ticks.select("sym", "date", "session", "row_nr", *RAW).withColumn("total_imbalance", F.lit(0.5)), RAW)
    got = rows.filter("sym = 1 AND row_nr IN (1, 3)").orderBy("row_nr").select("vector").collect()
    assert len(got[0].vector) == 5 * len(RAW) + 12
    assert got[0].vector[: len(RAW)] == got[0].vector[4 * len(RAW) : 5 * len(RAW)]
    assert got[1].vector[2 * len(RAW) : 3 * len(RAW)] == got[0].vector[: len(RAW)]


def row(spark, **values):
    base = {c: 1.0 for c in RAW} | {"sym": 1, "date": 0, "session": 0, "row_nr": 1, "tod": 0}
    return spark.createDataFrame([base | values])


def test_edge_rows(spark):
    assert row(spark, n_ask1=0.0).filter(exprs.at_limit()).count() == 1
    assert row(spark, n_close=0.095).filter(exprs.at_limit()).count() == 1
    assert row(spark, n_close=0.094).filter(exprs.at_limit()).count() == 0
    mid = lambda b, a: spark.sql(f"SELECT {exprs.mid_price(b, a)} AS m").first().m
    assert mid("0D", "3D") == 3 and mid("2D", "0D") == 2 and mid("0D", "0D") is None and mid("1D", "3D") == 2
    seconds = lambda t: spark.sql(f"SELECT {exprs.seconds(t)} AS s").first().s
    assert seconds("'09:30:05'") == 34205 and seconds("'9:30'") == 0 and seconds("'a:b:c'") == 0 and seconds("'10:00:01.9'") == 36001
    assert spark.sql(f"SELECT {exprs.clean('x')} AS y FROM VALUES (double('NaN')), (double('Infinity')), (NULL) AS t(x)").distinct().first().y == 0
    crossed = features_tabular.features(row(spark, n_bid1=2.0, n_ask1=1.0)).first()
    assert crossed.is_crossed_book == 1 and crossed.calc_midprice == 1.5


def test_empty_ticks(spark, ticks):
    none = ticks.filter("false")
    assert features_main.features(none).count() == 0
    assert candles.candles(none).count() == 0
    assert evaluate.threshold_sweep(none.selectExpr("0D AS down", "1D AS flat", "0D AS up", "1 AS y_true", "0D AS price_diff")).count() == 0


def test_signal_ties(spark):
    rows = spark.sql("SELECT * FROM VALUES (0.4D, 0.2D, 0.4D), (0.5D, 0.0D, 0.5D), (0.2D, 0.4D, 0.4D) AS t(down, flat, up)")
    d, f, u = F.col("down"), F.col("flat"), F.col("up")
    assert [r[0] for r in rows.select(signals.argmax(d, f, u)).collect()] == [0, 0, 1]
    assert [r[0] for r in rows.select(signals.threshold_rule(d, f, u, F.lit(0.45))).collect()] == [1, 2, 1]
    assert [r[0] for r in rows.select(signals.threshold_rule(d, f, u, F.lit(0.5))).collect()] == [1, 1, 1]
    assert [r[0] for r in rows.select(signals.sell_first_rule(d, u, F.lit(0.45))).collect()] == [1, 0, 1]


def test_no_signal_scores_zero(spark):
    rows = spark.sql("SELECT * FROM VALUES (0.3D, 0.4D, 0.3D, 0, 0.1D) AS t(down, flat, up, y_true, price_diff)")
    got = evaluate.threshold_sweep(rows, (0.9,)).first()
    assert got.trades == 0 and got.precision == 0 and got.avg_pnl == 0 and got.official_score_est == 0


def test_best_takes_the_first(spark):
    rows = spark.sql("SELECT * FROM VALUES (0.5D, -0.0D), (0.6D, 0.0D), (0.7D, -1D) AS t(threshold, m)")
    assert evaluate.best(rows, "m", "threshold").first().threshold == 0.5


def test_drawdown_in_stretches(spark):
    rng = np.random.default_rng(3)
    pnl = rng.normal(size=200)
    rows = spark.createDataFrame([(1, i // 17, i, float(x)) for i, x in enumerate(pnl)], "k int, stretch int, i int, pnl double")
    equity = np.cumsum(pnl)
    expected = min(0.0, (equity - np.maximum(np.maximum.accumulate(equity), 0)).min())
    assert evaluate.drawdown(rows, ["k"], ["i"]).first().max_drawdown == pytest.approx(expected)


def test_class_weights_of_absent_class(spark):
    rows = spark.sql("SELECT 0 AS label UNION ALL SELECT 0 UNION ALL SELECT 2")
    got = {r.label: r.weight for r in samples.class_weights(rows).collect()}
    assert got == {0: 3 / (2 * 2), 1: 1.0, 2: 3 / 2}


def test_duplicates_and_nulls(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, NULL), (1, NULL), (2, 3) AS t(a, b)")
    assert profile.duplicate_rows(rows, ["a", "b"]).first().duplicates == 1
    assert {r["column"]: r.nulls for r in profile.null_profile(rows, ["a", "b"]).collect()} == {"a": 0, "b": 2}


def test_one_exchange_for_all_windows(ticks, spark):
    plan = features_tabular.features(book(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
