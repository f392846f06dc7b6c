"""Moving windows by blocks against pandas and against Spark's own frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bookflow.functions import windows as w
from bookflow.operators import features_main, rolling
from bookflow.plans.book import book
from bookflow.plans.staged import Catalogue

DATA = "/root/testdata/sf0.001"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.floats(-1e6, 1e6), st.just(float("nan")), st.just(3.25)), min_size=1, max_size=40), min_size=1, max_size=5), st.integers(1, 12), st.integers(0, 6))
def test_frames_equal_pandas(groups, size, shift):
    x = np.concatenate([np.array(g) for g in groups])
    starts = np.cumsum([0, *(len(g) for g in groups[:-1])])
    layout = rolling.Layout(starts, len(x), size)
    for function, theirs in (("avg", "mean"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("stddev_samp", "std"), ("count", "count")):
        want = pd.concat([getattr(pd.Series(g).rolling(size, min_periods=0 if function == "count" else 1), theirs)().shift(shift) for g in groups]).to_numpy()
        if function == "count":
            want = np.nan_to_num(want)
        assert np.allclose(rolling.moving(function, x, layout, shift), want, rtol=1e-9, atol=1e-3 if function == "stddev_samp" else 1e-6, equal_nan=True), function
    lagged = np.concatenate([pd.Series(g).shift(shift).to_numpy() for g in groups])
    assert np.array_equal(rolling.moving("lag", x, rolling.Layout(starts, len(x), 1), shift), lagged, equal_nan=True)


def test_no_digits_are_lost_far_into_a_group():
    """A small deviation about a large level, after a million rows."""
    x = 1e9 + np.tile([0.0, 0.25, 0.5, 0.25], 250_000)
    got = rolling.moving("stddev_samp", x, rolling.Layout(np.array([0]), len(x), 100))
    assert got[-1] == pytest.approx(np.std(x[-100:], ddof=1), rel=1e-6)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_catalogue_equals_sparks_frames(spark, monkeypatch, batch):
    """All features of the main set that look back, whatever the size of a batch, with gaps and extra columns."""
    part = Catalogue(features_main.CATALOGUE.stages[:2])
    names = [n for n, _ in part.stages[1]]
    ticks = book(spark, DATA).selectExpr("* EXCEPT (n_midprice)", "CASE WHEN row_nr % 11 <> 3 THEN n_midprice END AS n_midprice", "'x' AS tag")
    keys = ["sym", "date", "session", "row_nr"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        ours = part.apply(ticks).select(*keys, "tag", *names).toPandas().sort_values(keys).reset_index(drop=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(rolling, "WORTH", 10**9)
    theirs = part.apply(ticks).select(*keys, "tag", *names).toPandas().sort_values(keys).reset_index(drop=True)
    assert len(ours) == len(theirs) and set(ours["tag"]) == {"x"}
    for n in names:
        a, b = ours[n].to_numpy(float), theirs[n].to_numpy(float)
        scale = 1e-4 if "zscore" in n else 1e-9 * max(1.0, np.nanmax(np.abs(b), initial=0))
        assert np.allclose(a, b, rtol=1e-7, atol=scale, equal_nan=True), n


def test_stages_with_other_windows_stay(spark):
    stage = [("a", w.rolling("avg", "x", 500)), ("b", w.first("x"))]
    assert rolling.calls_of(stage) == (stage, {})
    replaced, calls = rolling.calls_of([("a", f"{w.rolling('avg', 'abs(x)', 500)} + {w.lag('y', 3)} * {w.shifted_mean('x', 33, 66)}")])
    assert set(calls.values()) == {("avg", "abs(x)", 500, 0), ("lag", "y", 1, 3), ("avg", "x", 33, 66)} and " OVER " not in replaced[0][1]
    assert rolling.worth(calls) and not rolling.worth({"a": ("avg", "x", 10, 0)})


def test_one_exchange_and_pruned_columns(spark):
    names = [f"price_zscore_{k}" for k in features_main.LONG]
    part = features_main.CATALOGUE.needed(names)
    plan = part.apply(book(spark, DATA), ["sym", "date", "session", "row_nr", *names])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "n_asize5" not in "".join(plan.columns)
    assert part.apply(book(spark, DATA).filter("false")).count() == 0
