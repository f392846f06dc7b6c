"""Features and vectors that stream through one deal of narrow rows."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from bookflow import runtime
from bookflow.functions import windows as w
from bookflow.operators import features_main, profile, rolling, samples, vector
from bookflow.plans.book import LINE, book
from bookflow.queries_features import placed
from bookflow.registry import QUERIES

DATA = "/root/testdata/sf0.001"
KEYS = ["sym", "date", "session", "row_nr"]


def dealt(df) -> list[str]:
    """What each exchange of a plan deals, as the plan says it."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    details = plan[plan.index("\n\n") :]
    return [m[1] for m in re.finditer(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", details)]


@pytest.mark.parametrize("name", ["main_features_182", "pyramid_vector_922"])
def test_rows_are_dealt_once_while_they_are_narrow(spark, name):
    """one exchange of the table's own columns, one of sums by instrument."""
    rows, sums = sorted(dealt(QUERIES[name](spark, DATA)), key=lambda x: "sum#" in x)
    assert len(rows.split(", ")) <= len(LINE) + 3 and "n_bid1" not in rows
    assert "sum#" in sums


def test_streamed_vectors_equal_vectors_of_windows(spark):
    """whatever the batches, the vectors that a function sees are those of the window plan."""
    ticks = samples.with_targets(book(spark, DATA)).select(*KEYS, *features_main.RAW, "tod")
    names = features_main.FEATURES
    want = {tuple(r[:4]): r[4] for r in vector.pyramid(features_main.features(ticks), names).select(*KEYS, "vector").collect()}

    def shown(rows: pa.RecordBatch, vectors: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(rows.column(k) for k in KEYS), pa.array(list(vectors.copy()), pa.list_(pa.float32()))], names=[*KEYS, "vector"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
        got = vector.pyramid_stream(features_main.features(ticks, placed=True), names, shown, "sym long, date int, session int, row_nr int, vector array<float>").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(want) > 1000
    assert all(np.array_equal(np.float32(r[4]), np.float32(want[tuple(r[:4])])) for r in got)


def test_rows_that_have_their_places_arent_dealt_again(spark):
    ticks = rolling.ordered(book(spark, DATA).select(*KEYS, "n_midprice"))
    calls = {"m": ("avg", "n_midprice", 7, 0)}
    again = rolling.add(rolling.add(ticks, calls).withColumnRenamed("m", "m7"), {"m": ("max", "n_midprice", 9, 1)})
    assert len(dealt(again)) == 1
    want = ticks.selectExpr(*KEYS, f"{w.rolling('avg', 'n_midprice', 7)} AS m7", f"max(n_midprice) OVER ({w.OVER} ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS m").toPandas().sort_values(KEYS)
    got = again.select(*KEYS, "m7", "m").toPandas().sort_values(KEYS)
    assert np.allclose(got.to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_steps_are_what_rounding_gives(spark):
    values = [0.0, -0.0, 1e-7, -1e-7, -4.9e-5, 5.1e-5, -5.1e-5, 0.12345, -0.12345, 1234.56789, -98765.43211, 1e9 + 0.33333, float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for r in rows.selectExpr(f"{placed('x')} AS a", "round(x + 1.23456789e-7D, 4) AS b").collect():
        assert r.a == r.b and str(r.a) == str(r.b) or str(r.a) == str(r.b) == "nan"


def test_far_off_values_take_no_digits_from_deviations():
    x = np.array([3.25, 3.25, 3.25, 349358.8913547683, 3.25, 3.25, 3.25, 3.25, 3.25, 3.25])
    got = rolling.moving("stddev_samp", x, rolling.Layout(np.array([0]), len(x), 4))
    assert (got[[1, 2, 7, 8, 9]] == 0).all() and np.allclose(got[3:7], np.std(x[:4], ddof=1))


def test_wide_projections_are_compiled(spark):
    """a method over 8,000 bytes stays interpreted, so such projections are split; a stricter limit of the session stays."""
    name = runtime.METHOD
    spark.conf.set(name, "65535")
    runtime.compiled(spark)
    assert spark.conf.get(name) == "8000"
    spark.conf.set(name, "4000")
    runtime.compiled(spark)
    assert spark.conf.get(name) == "4000"
    spark.conf.unset(name)
    rows = QUERIES["report_windows"](spark, DATA)
    assert "bround" not in (plan := rows._jdf.queryExecution().optimizedPlan().toString()) and " round(" not in plan


def plain_comparison(ours, theirs):
    """What the comparison gives, from dictionaries of rows by key."""
    a, b = ({r[0]: r[1:] for r in rows} for rows in (ours, theirs))
    alike = lambda x, y: x == y or x is not None and y is not None and x != x and y != y
    return {c: (sum(alike(a[k][j], b[k][j]) for k in a if k in b), sum(not alike(a[k][j], b[k][j]) for k in a if k in b), len(a.keys() - b), len(b.keys() - a)) for j, c in enumerate("xy")}


def test_compared_tables_deal_only_what_differs(spark):
    """every row is compared; rows of buckets that agree aren't dealt. NULLs that trade places, NaN and 0 with a sign are told."""
    nan, schema = float("nan"), "k long, x double, y double"
    ours = [(k, float(k % 7), None if k % 5 else nan) for k in range(20_000)]
    table = lambda rows: spark.createDataFrame(rows, schema)
    got = lambda a, b: {r[0]: tuple(r[1:]) for r in profile.compare_tables(table(a), table(b), ["k"]).collect()}
    assert got(ours, ours[::-1]) == plain_comparison(ours, ours)
    theirs = [(7, None, 0.0) if k == 7 else (8, 1.0, 8.0) if k == 8 else (14, -0.0, None) if k == 14 else (k, x, y) for k, x, y in ours if k != 9] + [(-5, 1.0, 1.0)]
    assert got(ours, theirs) == plain_comparison(ours, theirs)
    assert got(ours, [(k, y, x) for k, x, y in ours]) == plain_comparison(ours, [(k, y, x) for k, x, y in ours])
    assert got(ours, []) == plain_comparison(ours, []) and got([], ours) == plain_comparison([], ours)
    assert got([(None, 1.0, 1.0)], [(None, 1.0, 1.0)])["x"] == (0, 0, 1, 1)


def test_buckets_that_agree_leave_nothing_to_join(spark):
    rows = spark.range(20_000).selectExpr("id AS k", "CAST(id % 7 AS DOUBLE) AS x")
    odd = rows.selectExpr("k", "IF(k = 77, -1D, x) AS x")
    read = lambda other: [r.n for r in profile.digests(rows, ["k"], ["x"]).join(profile.digests(other, ["k"], ["x"]).withColumnRenamed("digest", "d"), "bucket").selectExpr("count_if(digest != d) AS n").collect()]
    assert read(rows) == [0] and read(odd) == [1]
