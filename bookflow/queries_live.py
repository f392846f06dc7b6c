"""Queries of training, batch prediction and streams: streams, and the batch results that they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.operators import binned, boosting, candles, features_main, model, profile, samples, signals
from bookflow.operators.ewm import alpha_of
from bookflow.plans.book import book
from bookflow.queries_features import portable, shown
from bookflow.runtime import scratch
from bookflow.schema import HORIZONS
from bookflow.sources import sinks
from bookflow.streaming import live

NAMES = ["total_imbalance", "vol1_rel_diff", "relative_bid_density_1", "micro_price", "bid_slope"]
#: Small forests vote less firmly than the models that the shortest horizons' defaults are for.
THRESHOLDS = {**model.THRESHOLDS, 5: 0.4, 10: 0.5}
#: Earlier dates train, as in the query split_date.
FIRST_VALIDATION = 1996


def batch_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small forest for each horizon, fitted to its own move on all ticks before ``FIRST_VALIDATION``, applied to all ticks.

    As in ``with_targets``, a move past the group's end counts as 0, which is flat."""
    rows = samples.with_targets(features_main.CATALOGUE.needed(NAMES).apply(book(spark, sf_dir)))
    rows = rows.select("sym", "date", "session", "row_nr", F.array(*(F.col(n).cast("float") for n in NAMES)).alias("features"), *(f"price_diff_{h}" for h in HORIZONS), F.lit(1.0).alias("weight"))
    train = samples.split_by_date(rows, FIRST_VALIDATION).filter("split = 'train'")
    models = {}
    for h in HORIZONS:
        move = F.col(f"price_diff_{h}")
        labelled = train.withColumn("label", F.when(move < 0, 0.0).when(move > 0, 2.0).otherwise(1.0))
        models[h] = model.DirectionModel(options={"numTrees": 5, "maxDepth": 3}, seed=h).fit(labelled)
    return model.predict(rows, models, THRESHOLDS).select("sym", "date", "session", "row_nr", *(f"signal_{h}" for h in HORIZONS))


def softmax_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax boosting for the 20-tick move: trained from a binned store on all ticks before ``FIRST_VALIDATION``, ended by the loss
    over all later ones, applied to all ticks."""
    rows = samples.with_targets(features_main.CATALOGUE.needed(NAMES).apply(book(spark, sf_dir)))
    move = F.col("price_diff_20")
    label = F.when(move < 0, 0).when(move > 0, 2).otherwise(1)
    made = rows.select("sym", "date", "session", "row_nr", F.array(*(F.col(n).cast("float") for n in NAMES)).alias("features"), label.alias("label"), move.alias("price_diff"), (F.col("date") >= FIRST_VALIDATION).alias("validation"))
    path = scratch(spark, "softmax")
    made.write.parquet(f"{path}/samples")  # read by four passes, made once
    made = spark.read.schema(made.schema).parquet(f"{path}/samples")
    store = binned.write(made, f"{path}/store")
    options = boosting.Options(**boosting.PRESETS["previous_code"] | {"rounds": 8, "depth": 4, "rate": 0.2, "columns": 0.8})
    scored = boosting.Booster(options).fit(store, f"{path}/rounds").score(made.drop("price_diff", "validation"))
    rule = signals.threshold_rule(F.col("down"), F.col("flat"), F.col("up"), F.lit(0.4))
    return scored.select("sym", "date", "session", "row_nr", rule.alias("signal"))


def storage_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and moves of all ticks, written and read back, against the same made anew."""
    keys = ["sym", "date", "session", "row_nr"]
    rows = samples.with_targets(features_main.CATALOGUE.needed(NAMES).apply(book(spark, sf_dir))).select(*keys, *NAMES, *(f"price_diff_{h}" for h in HORIZONS))
    path = f"{scratch(spark, 'storage')}/features"
    sinks.write_features(rows, path)
    return profile.compare_tables(rows, spark.read.parquet(path), keys)


def _tick_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS sym", "event_id AS row_nr", "CAST(ts AS TIMESTAMP) AS ts", "value AS n_midprice", "1D AS amount_delta")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's own files as a stream."""
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    return source.selectExpr("user_id AS sym", "event_id AS row_nr", "CAST(ts AS TIMESTAMP) AS ts", "value AS n_midprice", "1D AS amount_delta")


def _run(writer, folder: str) -> None:
    """Run a stream to its end."""
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles of 30 minutes, updated batch by batch: each batch's changed candles are a folder, the last one of a candle holds."""
    folder = scratch(spark, "stream-candles")
    keep = lambda changed, batch: changed.write.mode("overwrite").parquet(f"{folder}/candles/batch={batch}")
    _run(live.candles(_stream(spark, sf_dir), "30 minutes", "1 hour").writeStream.outputMode("update").foreachBatch(keep), folder)
    columns = ["open", "high", "low", "close", "volume"]
    last = spark.read.parquet(f"{folder}/candles").groupBy("sym", "start").agg(F.max_by(F.struct(*columns), "batch").alias("c"))
    return last.select("sym", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), *(F.round(f"c.{c}", 4).alias(c) for c in columns))


def stream_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive averages of each event's value by user, from state of fixed size."""
    folder = scratch(spark, "stream-smoothed")
    _run(live.smoothed(_stream(spark, sf_dir), {"ema_5": 5.0, "ema_20": 20.0}).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows"), folder)
    return spark.read.parquet(f"{folder}/rows").selectExpr("sym", "row_nr", *(f"{shown(c)} AS {c}" for c in ("ema_5", "ema_20")))


def events_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles of 30 minutes of each user's events."""
    rows = _tick_rows(spark, sf_dir).selectExpr("*", "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT) AS tod", "CAST(to_date(ts) AS STRING) AS day")
    numbered = rows.selectExpr("* EXCEPT (row_nr)", "CAST(row_number() OVER (PARTITION BY sym, day ORDER BY ts, row_nr) AS INT) AS row_nr")
    found = candles.candles(numbered, 1800, keys=("sym", "day"))
    return found.select("sym", "day", "bucket", F.round("open", 4).alias("open"), F.round("high", 4).alias("high"), F.round("low", 4).alias("low"), F.round("close", 4).alias("close"), "ticks")


def _fold(span: float) -> str:
    a = alpha_of(span)
    return f"list_reduce(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda y, v: {1 - a!r} * y + {a!r} * v)"


QUERIES = {"batch_predict": batch_predict, "softmax_predict": softmax_predict, "storage_consistency": storage_consistency, "stream_candles": stream_candles, "stream_smoothed": stream_smoothed, "events_candles": events_candles}
ORACLE_SQL = {
    "storage_consistency": "SELECT c AS \"column\", count(*) AS equal, CAST(0 AS BIGINT) AS different, CAST(0 AS BIGINT) AS only_ours, CAST(0 AS BIGINT) AS only_theirs FROM lineitem, "
    f"(SELECT unnest({[*NAMES, *(f'price_diff_{h}' for h in HORIZONS)]}) AS c) GROUP BY c",
    "stream_candles": "SELECT user_id AS sym, strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, round(arg_min(value, (ts, event_id)), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(arg_max(value, (ts, event_id)), 4) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2",
    "stream_smoothed": portable(f"SELECT user_id AS sym, event_id AS row_nr, {shown('e5')} AS ema_5, {shown('e20')} AS ema_20 FROM (SELECT *, {_fold(5.0)} AS e5, {_fold(20.0)} AS e20 FROM events)"),
    "events_candles": "SELECT user_id AS sym, strftime(ts, '%Y-%m-%d') AS day, CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 1800) AS BIGINT) AS bucket, round(arg_min(value, (ts, event_id)), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(arg_max(value, (ts, event_id)), 4) AS close, count(*) AS ticks FROM events GROUP BY 1, 2, 3"
}
