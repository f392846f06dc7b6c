"""Recursive averages in stretches, correlations from matrices, windows predicted many at once."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookflow.operators import ewm, features_tabular, profile
from bookflow.plans.book import book

DATA = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.floats(-100, 100), st.just(float("nan"))), min_size=1, max_size=60), st.integers(1, 17), st.sampled_from([1.0, 0.5, 1 / 3, 2 / 27]))
def test_stretches_compose_to_the_whole(values, size, alpha):
    x = np.array(values)
    parts = [x[a : a + size] for a in range(0, len(x), size)]
    maps = pd.DataFrame([{"sym": 1, "date": 2, "session": 3, "stretch": k, "size": len(p), **dict(zip(("lead_y", "first_y", "slope_y", "offset_y", "tail_y"), ewm.reduced(p, alpha)))} for k, p in enumerate(parts)])
    maps["first_y"] = maps["first_y"].astype(float)
    begun = ewm.starts(maps, {"y": alpha})
    got = np.concatenate([ewm.walked(p, alpha, y, (1 - alpha) ** gap)[0] for p, y, gap in zip(parts, begun["y_y"], begun["gap_y"])])
    assert np.allclose(got, ewm.ewm(x, alpha), rtol=1e-9, atol=1e-9, equal_nan=True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.floats(-100, 100), st.just(float("nan"))), min_size=1, max_size=60), st.integers(1, 17), st.sampled_from([1.0, 0.5, 1 / 3, 2 / 27]))
def test_walking_on_equals_one_walk(values, size, alpha):
    x, got, y, old = np.array(values), [], np.nan, 1.0
    for a in range(0, len(x), size):
        part, old = ewm.walked(x[a : a + size], alpha, y, old)
        y = part[-1]
        got.append(part)
    assert np.array_equal(np.concatenate(got), ewm.ewm(x, alpha), equal_nan=True)
    if alpha < 1:
        assert np.allclose(ewm.ewm(x, alpha), pd.Series(x).ewm(alpha=alpha, adjust=False).mean(), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_recursive_features_dont_depend_on_batches(spark):
    """Groups longer and shorter than a batch, gaps at their edges, columns that pass through, the same digits."""
    ticks = book(spark, DATA, long=True).select("sym", "date", "session", "row_nr", F.expr("CASE WHEN row_nr % 13 > 2 AND row_nr NOT BETWEEN 40 AND 70 THEN n_midprice END").alias("n_midprice"), F.lit("t").alias("tag"), F.col("n_bid1").alias("rsv"), F.col("n_bsize1").alias("ofi_1"))
    found = {}
    for batch in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found[batch] = ewm.recursive_features(ticks).toPandas().sort_values(["sym", "date", "session", "row_nr"]).reset_index(drop=True)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pd.testing.assert_frame_equal(found[7], found[10_000], check_exact=True)
    want = found[7].groupby(["sym", "date", "session"]).n_midprice.transform(lambda x: x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean())
    assert np.allclose(found[7].macd_dif, want, equal_nan=True) and (found[7].tag == "t").all()
    assert ewm.recursive_features(ticks.filter("false")).count() == 0


@pytest.mark.parametrize("stretch", [7, 1000])
def test_scan_equals_one_pass(spark, stretch):
    ticks = book(spark, DATA, long=True).select("sym", "date", "session", "row_nr", F.expr("CASE WHEN row_nr % 13 > 2 AND row_nr NOT BETWEEN 40 AND 70 THEN n_midprice END").alias("x"), F.lit("t").alias("tag"))
    alphas = {"fast": ewm.alpha_of(5), "slow": ewm.alpha_of(26)}
    keys = ["sym", "row_nr"]
    ours, theirs = (f(ticks).toPandas().sort_values(keys).reset_index(drop=True) for f in (lambda t: ewm.scan(t, "x", alphas, stretch), lambda t: ewm.smooth(t, "x", alphas)))
    assert list(ours.columns) == list(theirs.columns)
    pd.testing.assert_frame_equal(ours, theirs, rtol=1e-9)


def test_a_long_group_takes_many_tasks(spark):
    n = 200_000
    ticks = spark.range(n).select(F.lit(1).alias("sym"), F.lit(1).alias("date"), F.lit(0).alias("session"), (F.col("id") + 1).cast("int").alias("row_nr"), (F.col("id") % 97).cast("double").alias("x"))
    done = ewm.scan(ticks, "x", {"y": 0.1}, 10_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as large data, which isn't put together
    try:
        parts = done.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 4 and max(r["count"] for r in parts) <= n * 0.6
    last = done.filter(F.col("row_nr") > n - 5).orderBy("row_nr").toPandas().y.to_numpy()
    assert np.allclose(last, ewm.ewm((np.arange(n) % 97).astype(float), 0.1)[-5:])


def test_correlations_of_all_tabular_features(spark):
    """207 columns at once; against DuckDB on pairs, missing values and constant columns among them."""
    made = features_tabular.features(book(spark, DATA, long=True).filter("sym < 4"))
    numeric = [c for c, kind in made.dtypes if kind in ("double", "int", "bigint") and c in features_tabular.FEATURES]
    assert len(numeric) >= 205
    got = {(r.a, r.b): r["corr"] for r in profile.correlations(made, numeric).collect()}
    assert len(got) == len(numeric) * (len(numeric) - 1) // 2
    frame = made.select(*numeric).toPandas()
    con = duckdb.connect()
    con.register("t", frame)
    rng = np.random.default_rng(5)
    pairs = sorted(got)
    for k in rng.choice(len(pairs), 60, replace=False):
        a, b = pairs[k]
        want = con.execute(f'SELECT corr("{a}"::DOUBLE, "{b}"::DOUBLE) FROM (SELECT * FROM t WHERE NOT isnan("{a}"::DOUBLE) AND NOT isnan("{b}"::DOUBLE))').fetchone()[0]
        if want is None or np.isnan(want) or frame[[a, b]].dropna().std().min() < 1e-9:
            continue
        assert got[a, b] == pytest.approx(want, abs=1e-8), (a, b)
    none = profile.correlations(made.filter("false"), numeric[:3]).collect()
    assert [r["corr"] for r in none] == [None] * 3
