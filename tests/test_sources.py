"""Snapshot files in a temporary folder: names, ties, malformed cells, spelling, completeness, ingestion."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from bookflow.operators import model
from bookflow.schema import RAW
from bookflow.sources import sinks, snapshots
from bookflow.streaming import live

HEAD = ["date", "time", "sym", *RAW, "label5", "label_10"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("snapshots")
    line = lambda d, t, s, x, extra="1,2": ",".join([str(d), t, str(s), *([str(x)] * len(RAW))]) + "," + extra
    write = lambda name, lines, head=HEAD: (base / name).write_text("\n".join([",".join(head), *lines]) + "\n")
    write("snapshot_sym1_date0_am.csv", [line(0, "09:30:00", 1, 0.1), line(0, "09:30:00", 1, 0.2), line(0, "09:29:00", 1, "bad"), line(0, "09:31:00", 1, "nan", ",")])
    write("snapshot_sym2_date10_pm.csv", [line(10, "13:00:00", 2, 0.5)])
    write("snapshot_sym12_date3_am.csv", [line(3, "10:00:00", 12, 0.5)])
    write("notes.csv", ["1"], ["x"])
    (base / "snapshot_sym1_date1_am.csv").write_text("")
    return str(base)


def test_names_and_ranges(spark, folder):
    files = snapshots.catalogue(spark, folder)
    assert files.count() == 5
    assert {(r.source_file, r.reason) for r in snapshots.unexpected(files).collect()} == {("notes.csv", "parse_failure"), ("snapshot_sym12_date3_am.csv", "out_of_range")}
    assert snapshots.missing(files).count() == 1580 - 3
    assert [r.sym_id for r in snapshots.select_files(files, first_date=3).collect()] == [12, 2]
    assert snapshots.select_files(files, session="am", most=1).first().source_file == "snapshot_sym1_date0_am.csv"
    zero = files.filter("source_file = 'notes.csv'").select(*snapshots.parsed_or_zero(F.col("path"))).first()
    assert tuple(zero) == (0, 0, 0)


def test_reading(spark, folder):
    rows = snapshots.read(spark, folder).filter("sym_id = 1").orderBy("row_nr").collect()
    assert [r.n_bid1 for r in rows] == [0.1, 0.2, None, None]
    assert [r.label_5 for r in rows] == [1.0, 1.0, 1.0, None]
    ticks = snapshots.ticks(snapshots.read(spark, folder).filter("sym_id = 1")).orderBy("row_nr").collect()
    assert [r.n_bid1 for r in ticks] == [None, 0.1, 0.2, None]
    status = {r.source_file: (r.rows, r.status) for r in snapshots.read_statuses(spark, folder).collect()}
    assert status["snapshot_sym1_date1_am.csv"] == (0, "empty") and status["snapshot_sym1_date0_am.csv"] == (4, "ok")
    fields = {r.source_file: r for r in snapshots.field_completeness(spark, folder, ["date", "label_5"]).collect()}
    assert fields["snapshot_sym2_date10_pm.csv"].missing == ["label_5"] and fields["notes.csv"].missing == ["date", "label_5"]


def test_ingest_and_sinks(spark, folder, tmp_path):
    stored = snapshots.ingest(spark, folder, str(tmp_path / "ticks"))
    assert stored.filter("date_id = 10").count() == 1
    assert sinks.is_complete(spark, str(tmp_path / "ticks")) and not sinks.is_complete(spark, str(tmp_path / "none"))
    rows = spark.sql("SELECT 'train' AS split, 1 AS label, 0.5D AS price_diff UNION ALL SELECT 'val', 2, 0.1D")
    assert sinks.write_samples(rows, str(tmp_path / "samples")).filter("split = 'val'").count() == 1
    assert sinks.write_features(rows.withColumn("date", F.lit(3)), str(tmp_path / "features")) == 2
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    assert '"label": 1' in sinks.to_json(rows) and "| train | 1 | 0.5 |" in sinks.to_markdown("r", {"t": rows})
    with pytest.raises(ValueError):
        sinks.to_json(rows, most=1)
    assert sinks.remove_with_counts(spark, str(tmp_path / "csv"))[0] > 0 and sinks.remove_with_counts(spark, str(tmp_path / "csv")) == (0, 0)


def test_signals_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("source_file,sym,pred,pnl,correct\na,1,2,0.5,Yes\nb,x,,bad,0\n")
    got = snapshots.read_signals(spark, str(tmp_path / "s.csv")).collect()
    assert (got[0].sym, got[0].pred, got[0].pnl, got[0].correct) == (1, 2, 0.5, True)
    assert (got[1].sym, got[1].pred, got[1].pnl, got[1].correct) == (0, 0, 0.0, False)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(60).selectExpr("id % 2 AS sym", "id AS row_nr", "timestamp_seconds(id * 7) AS ts", "CAST(id * id % 17 AS DOUBLE) AS n_midprice", "1D AS amount_delta")
    for k in range(3):  # files in the order of their times
        rows.filter(f"row_nr DIV 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = live.tick_stream(spark, str(tmp_path / "in"), rows.schema)

    def run(df, name, mode="append"):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).toPandas()

    got = run(live.smoothed(stream, {"a": 5.0}), "smoothed").sort_values(["sym", "row_nr"])
    batch = rows.toPandas().sort_values(["sym", "row_nr"])
    assert got.row_nr.tolist() == batch.row_nr.tolist()
    expected = batch.groupby("sym").n_midprice.transform(lambda x: x.ewm(span=5, adjust=False).mean())
    assert abs(got.a.to_numpy() - expected.to_numpy()).max() < 1e-12
    found = run(live.windowed_predictions(stream, lambda x: x.sum(axis=(1, 2)).astype(int) % 3, ["n_midprice"], 4), "predicted")
    assert len(found) == 60 - 2 * 3
    candles = run(live.candles(stream, "60 seconds", "10 seconds"), "candles", "complete")
    assert candles.volume.sum() == 60


def test_model(spark):
    rows = spark.range(300).selectExpr("array(CAST(id % 3 AS FLOAT), CAST(id % 7 AS FLOAT)) AS features", "CAST(id % 3 AS DOUBLE) AS label", "1D AS weight", "id")
    for kind in ("forest", "logistic"):
        fitted = model.DirectionModel(kind=kind, options={"numTrees": 5} if kind == "forest" else {"maxIter": 20}).fit(rows)
        scored = model.predict(rows, {5: fitted}, {5: 0.4})
        assert scored.filter("signal_5 = label").count() > 280


def test_a_large_file_is_read_by_many_tasks_in_order(spark, tmp_path):
    """Splits far smaller than the file, empty lines, quotes and two files: rows are numbered as in the files."""
    from bookflow.schema import RAW

    head = ["date", "time", "sym", "label5", *RAW]
    for sym, rows in ((1, 700), (2, 3), (3, 0)):
        lines = [",".join(head)]
        for k in range(rows):
            cells = [0, f"09:30:{k % 60:02d}", sym, k % 3, *(k + j for j in range(len(RAW)))]
            lines.append(",".join(f'"{c}"' if k % 5 == 0 else f" {c} " if k % 7 == 0 else str(c) for c in cells))
            lines += [""] * (k % 4 == 0)
        (tmp_path / f"snapshot_sym{sym}_date0_am.csv").write_text("\r\n".join(lines) + "\r\n")
    (tmp_path / "snapshot_sym4_date0_am.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = snapshots.read(spark, str(tmp_path))
        got = {(r.sym, r.row_nr): (r.time, r.label_5, r.n_close, r.n_asize5) for r in found.collect()}
        text = spark.read.text(str(tmp_path))
        assert text.rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(s, k + 1): (f"09:30:{k % 60:02d}", float(k % 3), float(k), float(k + len(RAW) - 1)) for s, n in ((1, 700), (2, 3)) for k in range(n)}
    assert got == want
    assert {(r.source_file[12], r["rows"]) for r in snapshots.read_statuses(spark, str(tmp_path)).collect()} == {("1", 700), ("2", 3), ("3", 0), ("4", 0)}


def test_what_a_sample_of_rows_offers(spark, tmp_path):
    from bookflow.operators import features_main
    from bookflow.schema import RAW

    names = [c for c in RAW if c != "n_bsize2"]
    lines = [",".join(["time", "sym", *names])] + [",".join(["09:30:00", "0", *("" if c == "n_ask4" and k < 400 else "1.5" for c in names)]) for k in range(410)]
    (tmp_path / "snapshot_sym0_date0_am.csv").write_text("\n".join(lines))
    columns = snapshots.sample_columns(spark, str(tmp_path))
    assert set(columns) == {"time", "sym", "date", *names} - {"n_ask4"}
    found = features_main.available([*columns, "n_bsize2", "n_ask4"])
    assert found == features_main.FEATURES
    with pytest.raises(ValueError):  # the total imbalance needs every size
        features_main.available(columns)
    assert "ask3_mean" not in features_main.available([c for c in RAW if c != "n_ask3"])
