"""The data source of snapshot files: same rows as the split reader, files pruned by name, streams, late files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.schema import RAW, SNAPSHOT
from bookflow.sources import snapshot_files, snapshots

HEAD = ["date", "time", "sym", "label5", *RAW]


def _file(base, sym, date, session, rows, when=None, head=HEAD):
    lines = [",".join(head)]
    for k in range(rows):
        cells = [date, f"09:30:{k % 60:02d}", sym, k % 3, *("bad" if k % 11 == j else "nan" if k % 13 == j else k + j / 8 for j in range(len(RAW)))]
        if k % 9 == 8:
            cells = cells[: 5 + k % 7]  # a short line
        lines.append(",".join(f'"{c}"' if k % 5 == 0 else f" {c} " if k % 7 == 0 else str(c) for c in cells) + (",more" if k % 6 == 0 else ""))
        lines += [""] * (k % 4 == 0)
    path = base / f"snapshot_sym{sym}_date{date}_{session}.csv"
    path.write_text("\r\n".join(lines) + "\r\n" * (k % 2 if rows else 0), newline="")
    if when:
        os.utime(path, (when, when))
    return path


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "snapshots"
    base.mkdir()
    for n, (sym, date, session, rows) in enumerate([(1, 0, "am", 40), (2, 0, "pm", 3), (1, 1, "am", 9000), (3, 2, "pm", 0), (12, 0, "am", 5)]):
        _file(base, sym, date, session, rows, 1_000_000 + n)
    (base / "snapshot_sym4_date0_am.csv").write_text("")
    (base / "other.csv").write_text('﻿time,"n_bid1",n_bid1,,x\n10:00:00,"1,5",2,3\n  \n11:00:00,"a""b",7\n', encoding="utf-8")
    for f in ("snapshot_sym4_date0_am.csv", "other.csv"):
        os.utime(base / f, (999_999, 999_999))
    return base


def _all(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rows_equal_those_of_the_split_reader(spark, folder):
    ours, theirs = snapshot_files.rows(spark, str(folder)), snapshots.read(spark, str(folder))
    assert ours.schema.simpleString() == theirs.schema.simpleString()
    want = _all(theirs)
    assert len(want) == 40 + 3 + 9000 + 5 + 3 and _all(ours) == want
    assert _all(ours) == want  # a second pass
    assert _all(snapshot_files.rows(spark, f"file://{folder}", partition_bytes=1)) == want


def test_names_prune_files(spark, folder):
    every = lambda: snapshot_files.rows(spark, str(folder), partition_bytes=1)
    parts = lambda df: df.rdd.getNumPartitions()
    assert parts(every()) == 7
    for condition, files in (("sym_id = 1", 2), ("date_id >= 1", 2), ("date_id < 1 AND session_name = 'am'", 3), ("sym_id IN (1, 12)", 3), ("source_file = 'other.csv'", 1), ("sym_id <= 2 AND session = 1", 1), ("n_bid1 > 5", 7), ("sym_id IS NULL", 7), ("sym_id = 7", 1)):
        kept = every().filter(condition)
        assert parts(kept) == files, condition
        assert _all(kept) == _all(snapshots.read(spark, str(folder)).filter(condition)), condition
    plan = every().filter("sym_id = 1 AND n_bid1 > 5")._jdf.queryExecution().executedPlan().toString()
    assert "sym_id" not in plan.split("Filter", 1)[1].split("\n")[0]  # Spark needn't test it again
    few = T.StructType([SNAPSHOT["time"], SNAPSHOT["n_bid1"]])
    got = snapshot_files.rows(spark, str(folder), few)
    assert got.columns[-2:] == ["time", "n_bid1"] and got.agg(F.sum("n_bid1")).first() == snapshots.read(spark, str(folder)).agg(F.sum("n_bid1")).first()


def test_empty_folder(spark, tmp_path):
    assert snapshot_files.rows(spark, str(tmp_path)).count() == 0


def _drain(df, tmp_path):
    done = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    done.awaitTermination()


def test_stream_reads_each_file_once_and_resumes(spark, folder, tmp_path):
    read = lambda: _drain(snapshot_files.stream(spark, str(folder)), tmp_path)
    read()
    read()  # nothing new
    _file(folder, 5, 3, "am", 6, 1_000_100)
    read()
    schema = snapshots.read(spark, str(folder)).schema
    assert _all(spark.read.schema(schema).parquet(str(tmp_path / "out"))) == _all(snapshots.read(spark, str(folder)))


@pytest.mark.parametrize("change", ["late", "gone"])
def test_a_file_under_an_older_time_or_gone_is_an_error(spark, folder, tmp_path, change):
    _drain(snapshot_files.stream(spark, str(folder)), tmp_path)
    if change == "late":
        _file(folder, 6, 3, "am", 2, 1_000_001)
    else:
        (folder / "other.csv").unlink()
    _file(folder, 7, 3, "am", 2, 1_000_200)
    with pytest.raises(Exception, match="older times"):
        _drain(snapshot_files.stream(spark, str(folder)), tmp_path)
