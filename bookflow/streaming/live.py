"""Ticks as a stream: candles with a watermark, and features and signals of each new tick from state of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bookflow.operators.ewm import alpha_of


def tick_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder, a few a micro-batch, the oldest first. Stateful steps take an instrument's ticks in that order."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def candles(ticks: DataFrame, interval: str = "30 seconds", late: str = "1 minute", time: str = "ts", price: str = "n_midprice", amount: str = "amount_delta", key: str = "sym") -> DataFrame:
    """Candles by event time; a window closes when the watermark has passed it. Ties of time go to the tick's number."""
    order = F.struct(time, "row_nr")
    grouped = ticks.withWatermark(time, late).groupBy(F.window(time, interval), key)
    return grouped.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(amount).alias("volume")).select(key, F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def smoothed(ticks: DataFrame, spans: dict[str, float], column: str = "n_midprice", key: str = "sym") -> DataFrame:
    """Recursive averages of each tick: the state is the last value of each, whatever the stream's length."""
    names = list(spans)
    alphas = np.array([alpha_of(s) for s in spans.values()])
    out = T.StructType([T.StructField(key, T.LongType()), T.StructField("row_nr", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    kept = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = np.array(state.get) if state.exists else None
        found = pd.concat(list(frames)).sort_values("row_nr")
        rows = []
        for x in found[column].to_numpy(float):
            now = np.full(len(names), x) if now is None else (1 - alphas) * now + alphas * x
            rows.append(now)
        state.update(tuple(float(v) for v in now))
        yield pd.DataFrame(rows, columns=names).assign(**{key: k[0], "row_nr": found["row_nr"].to_numpy()})[[key, "row_nr", *names]]

    return ticks.groupBy(key).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def windowed_predictions(ticks: DataFrame, predict: Callable[[np.ndarray], np.ndarray], columns: list[str], length: int = 100, key: str = "sym", at_once: int = 256) -> DataFrame:
    """A prediction for each tick that completes a window: the state is a ring of the last ``length`` ticks.

    ``predict`` takes up to ``at_once`` windows, (windows, length, columns), views of the ticks in order, and gives a signal each.
    """
    out = T.StructType([T.StructField(key, T.LongType()), T.StructField("row_nr", T.LongType()), T.StructField("signal", T.IntegerType())])
    kept = T.StructType([T.StructField("ring", T.ArrayType(T.DoubleType()))])

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0] if state.exists else [], float).reshape(-1, len(columns))
        found = pd.concat(list(frames)).sort_values("row_nr")
        rows = np.concatenate([held, found[columns].to_numpy(float)])
        signals = np.empty(0, np.int32)
        if len(rows) >= length:
            windows = np.lib.stride_tricks.sliding_window_view(rows, length, axis=0).transpose(0, 2, 1)
            signals = np.concatenate([np.asarray(predict(windows[a : a + at_once])) for a in range(0, len(windows), at_once)])
        ends = found["row_nr"].to_numpy()[len(found) - len(signals) :]
        state.update((rows[len(rows) - min(length - 1, len(rows)) :].ravel().tolist(),))
        yield pd.DataFrame({key: k[0], "row_nr": ends, "signal": signals.astype(np.int32)})

    return ticks.groupBy(key).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)
