"""The command line from snapshot files to signals, on generated sessions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from bookflow.__main__ import main
from bookflow.schema import LABELS, RAW


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    base, rng = tmp_path_factory.mktemp("sessions"), random.Random(4)
    for sym, date, session in ((0, 0, "am"), (0, 0, "pm"), (1, 0, "am"), (0, 1, "am")):
        lines, price = [",".join(["date", "time", "sym", *RAW, *LABELS])], 0.0
        for k in range(180):
            price += rng.gauss(0, 0.0006)
            value = {"n_close": price, "amount_delta": rng.randrange(1000), "n_midprice": price}
            value |= {f"n_bid{i}": price - 0.0001 * i for i in range(1, 6)} | {f"n_ask{i}": price + 0.0001 * i for i in range(1, 6)}
            cells = [date, f"{9 if session == 'am' else 13}:{30 + k // 60:02d}:{k % 60:02d}", sym, *(value.get(c, rng.randrange(1, 90)) for c in RAW), *(rng.randrange(3) for _ in LABELS)]
            lines.append(",".join(map(str, cells)))
        (base / f"snapshot_sym{sym}_date{date}_{session}.csv").write_text("\n".join(lines) + "\n")
    return str(base)


def csv(spark, path):
    return spark.read.option("header", "true").csv(path).collect()


def test_eda(spark, data, tmp_path):
    main(["eda", data, str(tmp_path), "--syms", "2", "--dates", "2"], spark)
    assert len(csv(spark, f"{tmp_path}/missing_files")) == 4
    assert {r.rows for r in csv(spark, f"{tmp_path}/file_rows")} == {"180"}
    assert {r.crossed for r in csv(spark, f"{tmp_path}/crossed_book")} == {"0"}
    assert spark.read.text(f"{tmp_path}/summary").count() > 20


def test_tabular_drops_incomplete_rows(spark, data, tmp_path, capsys):
    main(["tabular", data, str(tmp_path)], spark)
    # Of 180 ticks the first 99 lack a full window, and the last 60 stay anyway.
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"rows": 4 * 81, "features": 207}


def test_samples_train_analyze(spark, data, tmp_path, capsys):
    main(["ingest", data, str(tmp_path / "ticks")], spark)
    main(["samples", str(tmp_path / "ticks"), str(tmp_path / "samples"), "--val-start-date", "1", "--horizon", "5"], spark)
    stored = spark.read.parquet(str(tmp_path / "samples"))
    assert {r.split: r["count"] for r in stored.groupBy("split").count().collect()} == {"train": 3 * 176, "val": 176}
    assert len(stored.first().features) == 922
    options = ["--val-start-date", "1", "--horizon", "5"]
    main(["check", data, str(tmp_path / "samples"), *options], spark)
    with pytest.raises(SystemExit):
        main(["check", data, str(tmp_path / "samples"), *options, "--min-history", "5"], spark)
    main(["train", str(tmp_path / "samples"), str(tmp_path / "run"), "--horizon", "5", "--kind", "forest", "--metric", "f05"], spark)
    assert len(csv(spark, f"{tmp_path}/run/thresholds")) == 23 and len(csv(spark, f"{tmp_path}/run/confusion")) == 9
    main(["analyze", data, str(tmp_path / "out"), "--stride", "3", "--sym", "0"], spark)
    summary = csv(spark, f"{tmp_path}/out/summary")
    assert [r.horizon for r in summary] == ["5", "10", "20", "40", "60"]
    assert {float(r.precision) for r in summary} == {1.0}
    assert spark.read.parquet(f"{tmp_path}/out/candles").count() > 0
    main(["analyze", data, str(tmp_path / "again"), "--mode", "signals", "--signals", f"{tmp_path}/out/signals", "--sym", "0"], spark)
    assert csv(spark, f"{tmp_path}/again/summary") == summary


def test_every_horizon_is_trained(spark, data, tmp_path, capsys):
    main(["samples", data, str(tmp_path / "samples"), "--val-start-date", "1"], spark)
    narrow = spark.read.parquet(str(tmp_path / "samples")).withColumn("features", F.slice("features", 1, 4))
    narrow.write.partitionBy("split", "label").parquet(str(tmp_path / "narrow"))
    capsys.readouterr()
    main(["train", str(tmp_path / "narrow"), str(tmp_path / "run"), "--horizon", "0", "--kind", "logistic", "--metric", "default"], spark)
    assert [json.loads(x)["horizon"] for x in capsys.readouterr().out.strip().splitlines()] == [5, 10, 20, 40, 60]
    rows = {h: sum(int(r.n) for r in csv(spark, f"{tmp_path}/run/{h}/confusion")) for h in (5, 60)}
    assert rows == {5: 176, 60: 176}
    (tmp_path / "published.json").write_text(json.dumps({f"label_{h}": {"val": [[100, 0, 0], [0, 50, 0], [30, 0, 0]]} for h in (5, 10, 20, 40, 60)}))
    main(["compare", str(tmp_path / "run"), str(tmp_path / "differences"), "--reference", str(tmp_path / "published.json")], spark)
    differences = csv(spark, f"{tmp_path}/differences")
    assert [(r.label, r.sample_diff) for r in differences] == [(f"label_{h}", "-4") for h in (10, 20, 40, 5, 60)]
    assert {round(float(r.reference_accuracy), 6) for r in differences} == {round(150 / 180, 6)}


def test_analyze_takes_its_filters_seriously(spark, data, tmp_path):
    main(["ingest", data, str(tmp_path / "ticks")], spark)
    main(["analyze", data, str(tmp_path / "a"), "--sym", "0", "--session", "am"], spark)
    main(["analyze", str(tmp_path / "ticks"), str(tmp_path / "b"), "--sym", "0", "--session", "am"], spark)
    first, second = (sorted(map(str, csv(spark, f"{tmp_path}/{k}/signals"))) for k in "ab")
    assert first == second and {r.sym for r in csv(spark, f"{tmp_path}/b/signals")} == {"0"}
    for source in (data, str(tmp_path / "ticks")):
        with pytest.raises(SystemExit):
            main(["analyze", source, str(tmp_path / "c"), "--sym", "7"], spark)


def test_analyze_with_five_models(spark, data, tmp_path):
    """Each horizon's signals are its own model's, by its own threshold, from lone windows."""
    from bookflow.operators import lone, samples, signals, vector
    from bookflow.operators import features_main
    from bookflow.__main__ import ticks_of
    from bookflow.operators.model import DirectionModel

    main(["samples", data, str(tmp_path / "samples"), "--val-start-date", "1"], spark)
    rows = spark.read.parquet(str(tmp_path / "samples"))
    for h, bias in zip((5, 10, 20, 40, 60), (0, 1, 2, 0, 2)):  # unlike models: another feature and another class each
        x = F.element_at("features", 5 + h)
        labelled = rows.withColumns({"label": F.when(F.col("row_nr") % 3 == 0, F.lit(float(bias))).when(x > 20, 2.0).otherwise(1.0), "weight": F.lit(1.0)})
        DirectionModel(kind="forest", options={"numTrees": 3, "maxDepth": 3}, seed=h).fit(labelled).save(f"{tmp_path}/run/{h}/model")
    (tmp_path / "run" / "5" / "threshold").mkdir(parents=True)
    from bookflow.sources import sinks

    sinks.write_text(spark, json.dumps({"threshold": 0.31}), f"{tmp_path}/run/5/threshold")
    main(["analyze", data, str(tmp_path / "out"), "--mode", "model", "--model", str(tmp_path / "run"), "--stride", "7", "--max-windows", "2", "--max-markers", "1"], spark)
    got = {(int(r.sym), int(r.date), int(r.session), int(r.row_nr), int(r.horizon)): int(r.signal) for r in csv(spark, f"{tmp_path}/out/signals")}
    ticks = ticks_of(spark, data)
    copies = samples.lone_windows(ticks, 100, 1)
    vectors = vector.pyramid(features_main.features(copies), features_main.FEATURES).filter("row_nr = 100").selectExpr("sym", "date", "window_end + 1 AS row_nr", "CAST(floor(session / 1099511627776L) AS INT) AS session", "vector AS features")
    vectors = vectors.filter("row_nr IN (100, 107)").persist()
    want = {}
    for h, threshold in {5: 0.31, 10: 0.82, 20: 0.78, 40: 0.70, 60: 0.65}.items():
        scored = DirectionModel.load(f"{tmp_path}/run/{h}/model").score(vectors)
        rule = signals.threshold_rule(F.col("down"), F.col("flat"), F.col("up"), F.lit(threshold))
        want |= {(r.sym, r.date, r.session, r.row_nr, h): r.signal for r in scored.select("sym", "date", "session", "row_nr", rule.alias("signal")).collect()}
    assert got == want and len(got) == 4 * 2 * 5 and len({tuple(got[k[:4] + (h,)] for k in sorted(got) if k[4] == h) for h in (5, 10, 20, 40, 60)}) > 1
    marks = spark.read.parquet(f"{tmp_path}/out/markers").collect()
    assert all(r.candle_idx == (r.row_nr - 1) // 30 for r in marks)  # a tick a second, candles of 30
    alone = lone.window_vectors(ticks).count()
    assert alone == 4 * 81
