"""Every registered query with SQL against DuckDB on the small tables, value by value."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from bookflow.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind in "fiu" or str(df[c].dtype).startswith("Int"):
            df[c] = df[c].astype(float) + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, engine, name):
    ours, theirs = ordered(QUERIES[name](spark, DATA).toPandas()), ordered(engine.execute(ORACLE_SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for c in ours:
        a, b = ours[c], theirs[c]
        if a.dtype.kind == "f":
            assert np.array_equal(a.to_numpy(), b.to_numpy(float), equal_nan=True), c
        else:
            assert a.astype(object).where(a.notna(), None).tolist() == b.astype(object).where(b.notna(), None).tolist(), c


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLE_SQL) <= {"batch_predict", "softmax_predict"}


def test_softmax_predict_covers_every_tick(spark, engine):
    """Trained by what tests/test_boosting.py compares with plain trees; here: a signal for each tick, all of them."""
    got = QUERIES["softmax_predict"](spark, DATA).toPandas()
    assert len(got) == engine.execute("SELECT count(*) FROM lineitem").fetchone()[0] == len(got.drop_duplicates(["sym", "date", "session", "row_nr"]))
    assert set(got["signal"]) <= {0, 1, 2} and len(set(got["signal"])) > 1
