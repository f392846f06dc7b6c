"""Command line: python -m bookflow COMMAND ... on folders of snapshot files.

    ingest DATA OUT                     snapshot files to Parquet by day
    eda DATA OUT                        quality reports (CSV) and a summary (Markdown)
    tabular DATA OUT                    the tabular features of complete rows, with row counts by file
    samples DATA OUT                    training samples: pyramid vectors, labels, price moves, split
    check DATA SAMPLES                  whether written samples equal those made anew, column by column
    train SAMPLES OUT                   a model and the metrics of every threshold, for one horizon or (--horizon 0) for each
    analyze DATA OUT                    signals, their summary and candles; predictions from labels, a model or earlier signals
    compare RUN OUT                     confusion matrices of a run of all horizons against published ones
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.functions.exprs import seconds
from bookflow.operators import binned, boosting, candles, evaluate, features_main, features_tabular, lone, profile, samples, signals, vector
from bookflow.operators.model import PRESETS, THRESHOLDS, DirectionModel, predict
from bookflow.runtime import ship
from bookflow.schema import ASIZES, BSIZES, HORIZONS, LABELS, RAW
from bookflow.sources import sinks, snapshots

KINDS = ["forest", "logistic", "boosted", "softmax"]


def ticks_of(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks of snapshot files, or of what ``ingest`` wrote, with seconds of the day."""
    names = [r.path for r in snapshots.listed(spark, folder).limit(1).collect()]
    rows = snapshots.read(spark, folder) if names else spark.read.parquet(folder)
    return snapshots.ticks(rows).selectExpr("*", f"{seconds('time')} AS tod")


def eda(spark: SparkSession, a: argparse.Namespace) -> None:
    files, ticks = snapshots.catalogue(spark, a.data), ticks_of(spark, a.data).persist()
    try:
        reports = {
            "missing_files": snapshots.missing(files, a.syms, a.dates),
            "unexpected_files": snapshots.unexpected(files, a.syms, a.dates),
            "file_rows": snapshots.read_statuses(spark, a.data),
            "nulls": profile.null_profile(ticks, RAW + LABELS),
            "duplicates": profile.duplicate_rows(ticks, ["source_file", "time", *RAW]),
            "infinite": profile.infinite_counts(ticks, RAW),
            "monotonic_time": profile.monotonic_time(ticks).filter("NOT monotonic"),
            "crossed_book": profile.crossed_book(ticks),
            "level_inversion": profile.level_inversion(ticks),
            "negative_sizes": profile.negative_sizes(ticks, BSIZES + ASIZES),
            "outliers": profile.outliers(ticks, RAW),
            "spread": profile.describe_column(ticks.selectExpr("n_ask1 - n_bid1 AS spread"), "spread"),
            "midprice": profile.midprice_summary(ticks),
            "label_direction": profile.label_direction(ticks),
            "correlations": profile.correlations(ticks, RAW),
            **{f"counts_{label}": profile.value_counts(ticks, label) for label in LABELS},
        }
        for name, df in reports.items():
            sinks.write_csv(df, f"{a.out}/{name}")
        sinks.write_text(spark, sinks.to_markdown("Quality of snapshots", reports), f"{a.out}/summary")
    finally:
        ticks.unpersist()


def tabular(spark: SparkSession, a: argparse.Namespace) -> None:
    kept = features_tabular.complete_rows(features_tabular.features(ticks_of(spark, a.data)))
    print(json.dumps({"rows": sinks.write_features(kept, f"{a.out}/features"), "features": len(features_tabular.FEATURES)}))


def sample_rows(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Features once, labels and moves of all horizons beside them; ``label`` and ``price_diff`` are the chosen horizon's."""
    targeted = samples.with_targets(ticks_of(spark, a.data))
    featured = features_main.features(targeted)
    vectors = vector.pyramid(featured, features_main.FEATURES)
    rows = samples.emit(vectors, a.min_history, a.keep_limit_samples)
    split = samples.split_by_date(rows, a.val_start_date) if a.split_mode == "date" else samples.split_by_index(rows, a.test_size)
    label = {h: F.coalesce(F.col(f"label_{h}").cast("int"), F.lit(1)) for h in HORIZONS}
    every = [x for h in HORIZONS for x in (label[h].alias(f"label_{h}"), F.col(f"price_diff_{h}"))]
    return split.select("sym", "date", "session", "row_nr", "split", label[a.horizon].alias("label"), F.col("vector").alias("features"), F.col(f"price_diff_{a.horizon}").alias("price_diff"), *every)


def make_samples(spark: SparkSession, a: argparse.Namespace) -> None:
    stored = sinks.write_samples(sample_rows(spark, a), a.out)
    counts = {r.split: r["count"] for r in stored.groupBy("split").count().collect()}
    if set(counts) != {"train", "val"}:
        raise SystemExit(f"a split is empty: {counts}")
    print(json.dumps({"samples": counts, "targets": [f"price_diff_{h}" for h in HORIZONS]}))


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    """Options must be those that the samples were made with."""
    found = profile.compare_tables(sample_rows(spark, a), spark.read.parquet(a.out), ["sym", "date", "session", "row_nr"]).collect()  # a row a column
    wrong = {r["column"]: r.different for r in found if r.different}
    one = {k: found[0][k] for k in ("only_ours", "only_theirs")}
    print(json.dumps({"columns": len(found), "different": wrong, **one}))
    if wrong or any(one.values()):
        raise SystemExit("stored samples differ")


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    """Each horizon is a model of its own, in a folder of its own where all are trained."""
    rows = spark.read.parquet(a.data)
    if a.horizon:
        train_one(rows, a, a.horizon, a.out)
    else:
        for h in HORIZONS:
            train_one(rows.withColumns({"label": F.col(f"label_{h}"), "price_diff": F.col(f"price_diff_{h}")}), a, h, f"{a.out}/{h}")


def train_softmax(rows: DataFrame, a: argparse.Namespace, horizon: int, out: str) -> DirectionModel:
    """Train from a binned store, which is reused where it was made from the same sample files and options; with ``--resume`` from
    the last saved rounds."""
    spark, options = rows.sparkSession, boosting.PRESETS[a.param_preset] | {"rounds": a.rounds, "patience": a.patience, "save_every": a.save_every}
    if a.class_weights != "preset":
        options |= {"class_weights": a.class_weights == "on"}
    if a.profit_weight:
        options |= {"profit": (a.profit_base, a.profit_alpha, a.profit_min, a.profit_max)}
    made_from = binned.folder_fingerprint(spark, a.data, {"horizon": horizon, "max_bin": a.max_bin})
    store = binned.find(spark, f"{out}/store", made_from) if a.reuse_store else None
    reused = store is not None
    store = store or binned.write(rows, f"{out}/store", made_from, max_bin=a.max_bin)
    if not a.resume:
        sinks.remove_with_counts(spark, f"{out}/rounds")
    booster = boosting.Booster(boosting.Options(**options)).fit(store, f"{out}/rounds")
    print(json.dumps({"horizon": horizon, "store_reused": reused, "best_loss": min(booster.losses, default=None)}))
    return DirectionModel(kind="softmax", fitted=booster)


def train_one(rows: DataFrame, a: argparse.Namespace, horizon: int, out: str) -> None:
    rows = rows.withColumn("label", F.col("label").cast("int")).withColumn("validation", F.col("split") == "val")
    training = rows.filter("NOT validation")
    seen = rows if a.kind == "boosted" else training
    if a.kind == "softmax":
        fitted = train_softmax(rows, a, horizon, out)
    else:
        if a.profit_weight:
            weighted = samples.profit_weights(seen, a.profit_base, a.profit_alpha, a.profit_min, a.profit_max, training=training)
        else:
            weights = samples.class_weights(training).select("label", "weight")
            weighted = seen.join(F.broadcast(weights), "label")
        fitted = DirectionModel(preset=a.preset, kind=a.kind).fit(weighted.withColumn("label", F.col("label").cast("double")), "validation")
    fitted.save(f"{out}/model")
    scored = fitted.score(rows.filter("validation")).selectExpr("down", "flat", "up", "label AS y_true", "price_diff").persist()
    try:
        sweep = evaluate.threshold_sweep(scored)
        sinks.write_csv(sweep.orderBy("threshold"), f"{out}/thresholds")
        chosen = THRESHOLDS[horizon] if a.metric == "default" else evaluate.best(sweep, a.metric, "threshold").first().threshold
        at = scored.withColumn("signal", signals.threshold_rule(F.col("down"), F.col("flat"), F.col("up"), F.lit(float(chosen))))
        sinks.write_csv(evaluate.confusion(at.withColumn("split", F.lit("val")), "split"), f"{out}/confusion")
        report = evaluate.class_report(at)
        sinks.write_csv(report, f"{out}/report")
        sinks.write_text(rows.sparkSession, json.dumps({"horizon": horizon, "threshold": chosen, "metric": a.metric}), f"{out}/threshold")
        sinks.write_text(rows.sparkSession, evaluate.report_text(f"label_{horizon}", chosen, report, evaluate.confusion(at)), f"{out}/report_text")
        if a.ratios:
            sinks.write_csv(evaluate.best(evaluate.ratio_grid(scored), "f05", "down_ratio", "up_ratio"), f"{out}/ratio_best")
    finally:
        scored.unpersist()
    print(json.dumps({"horizon": horizon, "threshold": chosen, **({"rounds": fitted.rounds()} if a.kind in ("boosted", "softmax") else {})}))


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    runs = [spark.read.option("header", "true").csv(f"{a.data}/{h}/confusion").select(F.lit(f"label_{h}").alias("label"), "split", *(F.col(c).cast("int") for c in ("y_true", "signal")), F.col("n").cast("long")) for h in HORIZONS]
    ours = runs[0]
    for more in runs[1:]:
        ours = ours.unionByName(more)
    theirs = evaluate.reference_cells(spark.read.text(a.reference, wholetext=True)).join(ours.select("label", "split").distinct(), ["label", "split"], "left_semi")
    sinks.write_csv(evaluate.confusion_diff(ours, theirs, "label", "split").orderBy("label", "split"), a.out)


def predicted(ticks: DataFrame, wanted: DataFrame, a: argparse.Namespace) -> DataFrame:
    """The wanted ticks' signals of all horizons: a model and a threshold each, from the last ``window`` ticks alone (or, with
    ``--features session``, from all the ticks of the session before)."""
    spark = ticks.sparkSession
    if a.features == "lone":
        vectors = lone.window_vectors(ticks, a.window)
    else:
        vectors = vector.pyramid(features_main.features(ticks), features_main.FEATURES)
    samples_ = vectors.select("sym", "date", "session", "row_nr", F.col("vector").alias("features")).join(wanted, ["sym", "date", "session", "row_nr"], "left_semi")
    models = {h: DirectionModel.load(f"{a.model}/{h}/model", a.kind) for h in HORIZONS}
    thresholds = {h: a.threshold if a.threshold is not None else saved_threshold(spark, f"{a.model}/{h}", THRESHOLDS[h]) for h in HORIZONS}
    return predict(samples_, models, thresholds)


def saved_threshold(spark: SparkSession, run: str, default: float) -> float:
    """What ``train`` chose."""
    if not sinks.is_complete(spark, f"{run}/threshold"):
        return default
    return json.loads(spark.read.text(f"{run}/threshold").first()["value"])["threshold"]


def analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    ticks = ticks_of(spark, a.data)
    files = snapshots.catalogue(spark, a.data)
    if files.isEmpty():  # what ingest wrote: each row names its file
        files = ticks.select("source_file", "sym_id", "date_id", F.col("session_name").alias("session")).distinct()
    chosen = snapshots.select_files(files, a.sym, a.first_date, a.last_date, a.session, a.max_files).select("source_file")
    if chosen.isEmpty():
        raise SystemExit("no file matches the filters")
    ticks = ticks.join(chosen, "source_file", "left_semi")
    if a.mode == "signals":
        earlier = snapshots.read_signals(spark, a.signals).withColumnsRenamed({"pred": "signal", "actual": "y_true", "row_idx": "row_nr"})
        done = earlier.join(chosen, "source_file", "left_semi").withColumns({c: F.col(c).cast("int") for c in ("horizon", "signal", "y_true", "row_nr")} | {"price_diff": F.col("price_diff").cast("double")})
        return write_analysis(done, ticks, a)
    rows = samples.endpoints(samples.with_targets(ticks).drop("local_idx"), a.window, max(HORIZONS), a.stride, a.max_windows)
    horizon = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.coalesce(F.col(f"label_{h}").cast("int"), F.lit(1)).alias("y_true"), F.col(f"price_diff_{h}").alias("price_diff")) for h in HORIZONS)))
    long = rows.select("source_file", "sym", "date", "session", "row_nr", "time", F.col("n_midprice").alias("entry_mid"), horizon.alias("h")).select("source_file", "sym", "date", "session", "row_nr", "time", "entry_mid", "h.*")
    if a.mode == "model":
        keys = ["sym", "date", "session", "row_nr"]
        called = predicted(ticks, rows.select(*keys), a)
        signal = F.create_map(*(x for h in HORIZONS for x in (F.lit(h), F.col(f"signal_{h}"))))
        long = long.join(called.select(*keys, signal.alias("signals")), keys).withColumn("signal", F.element_at("signals", F.col("horizon"))).drop("signals")
    else:
        long = long.withColumn("signal", F.col("y_true"))
    done = long.withColumns({"exit_mid": F.col("entry_mid") + F.col("price_diff"), "pnl": signals.pnl(F.col("signal"), F.col("price_diff")), "correct": F.col("signal") == F.col("y_true")})
    done.write.mode("overwrite").option("header", "true").csv(f"{a.out}/signals")
    write_analysis(done, ticks, a)


def write_analysis(done: DataFrame, ticks: DataFrame, a: argparse.Namespace) -> None:
    done = done.withColumn("pnl", signals.pnl(F.col("signal"), F.col("price_diff")))
    trades = done.filter("signal <> 1").withColumn("stretch", F.struct("date", "session", "sym"))
    fall = evaluate.drawdown(trades, ["horizon"], ["row_nr"])
    sinks.write_csv(evaluate.signal_summary(done).join(fall, "horizon", "left").orderBy("horizon"), f"{a.out}/summary")
    candles.numbered(candles.candles(ticks, a.candle_seconds)).write.mode("overwrite").parquet(f"{a.out}/candles")
    drawn = candles.thinned(trades.drop("stretch"), a.max_markers, ("source_file", "horizon"))
    candles.of_rows(drawn, ticks.sparkSession.read.parquet(f"{a.out}/candles")).write.mode("overwrite").parquet(f"{a.out}/markers")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="bookflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple) -> None:
        p = commands.add_parser(name)
        p.add_argument("data")
        p.add_argument("out")
        for flag, kind, default in options:
            p.add_argument(flag, **({"action": "store_true"} if kind is bool else {"choices": kind, "default": default} if isinstance(kind, list) else {"type": kind, "default": default}))
        p.set_defaults(run=run)

    horizon = ("--horizon", int, 20)
    command("ingest", lambda s, a: snapshots.ingest(s, a.data, a.out))
    command("eda", eda, ("--syms", int, 10), ("--dates", int, 79))
    command("tabular", tabular)
    made = (horizon, ("--split-mode", ["date", "index"], "date"), ("--val-start-date", int, 63), ("--test-size", float, 0.2), ("--min-history", int, 4), ("--keep-limit-samples", bool, False))
    command("samples", make_samples, *made)
    command("check", check, *made)
    softmax = (("--param-preset", sorted(boosting.PRESETS), "previous_code"), ("--class-weights", ["preset", "on", "off"], "preset"), ("--rounds", int, 2000), ("--patience", int, 100), ("--save-every", int, 250), ("--max-bin", int, 256), ("--reuse-store", bool, False), ("--resume", bool, False))
    command("train", train, horizon, *softmax, ("--kind", KINDS, "forest"), ("--preset", sorted(PRESETS), "fast"), ("--metric", ["default", "f05", "total_pnl", "avg_pnl", "official_score_est"], "official_score_est"), ("--ratios", bool, False), ("--profit-weight", bool, False), ("--profit-base", float, 1.0), ("--profit-alpha", float, 1.0), ("--profit-min", float, 0.5), ("--profit-max", float, 3.0))
    command("compare", compare, ("--reference", str, None))
    command("analyze", analyze, ("--mode", ["label", "model", "signals"], "label"), ("--model", str, None), ("--kind", KINDS, "forest"), ("--signals", str, None), ("--threshold", float, None), ("--features", ["lone", "session"], "lone"), ("--max-windows", int, None), ("--max-markers", int, 250), ("--sym", int, None), ("--first-date", int, None), ("--last-date", int, None), ("--session", ["am", "pm"], None), ("--max-files", int, None), ("--window", int, 100), ("--stride", int, 1), ("--candle-seconds", int, 30))
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("bookflow").getOrCreate()
    ship(spark)
    given.run(spark, given)


if __name__ == "__main__":
    main()
