"""Vectors of one tick from cleaned features of it and the ticks before it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.functions import windows as w
from bookflow.operators import rolling
from bookflow.operators.binned import matrix
from bookflow.schema import GROUP

# Ticks back that the vector holds in full, and of which it holds mid price and imbalance.
RECENT = (0, 1, 2, 3, 4)
SUMMARY = (5, 10, 20, 40, 80, 100)
#: Vectors that are in memory together.
VECTORS = 256


def pyramid_names(features: list[str]) -> list[str]:
    return [f"{c}_t{k}" for k in RECENT for c in features] + [f"{n}_lag{k}" for k in SUMMARY for n in ("mid", "imb")]


def pyramid(featured: DataFrame, features: list[str], mid: str = "n_midprice", imbalance: str = "total_imbalance") -> DataFrame:
    """``vector``: the last five ticks in full, then mid price and imbalance further back; before a group's first tick, that tick.

    The features travel as one array, so that a lag is one window expression and not one for each column.
    """
    packed = featured.withColumn("now", F.array(*(F.col(c).cast("float") for c in features)))
    lags = packed.selectExpr("*", *(f"{w.clamped('now', k)} AS back_{k}" for k in RECENT[1:]), *(f"{w.clamped(c, k)} AS {n}_{k}" for k in SUMMARY for n, c in (("mid", mid), ("imb", imbalance))))
    parts = [F.col("now"), *(F.col(f"back_{k}") for k in RECENT[1:]), F.array(*(F.col(f"{n}_{k}").cast("float") for k in SUMMARY for n in ("mid", "imb")))]
    return lags.withColumn("vector", F.concat(*parts)).drop("now", *(f"back_{k}" for k in RECENT[1:]), *(f"{n}_{k}" for k in SUMMARY for n in ("mid", "imb")))


def pyramid_stream(featured: DataFrame, features: list[str], function: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str, mid: str = "n_midprice", imbalance: str = "total_imbalance") -> DataFrame:
    """The rows that ``function`` makes of ticks and the matrix of their vectors, a few hundred at a time, as a model reads them: the vectors
    of :func:`pyramid`, none of which leaves its task. ``featured`` has cleaned features and comes with its places (``rolling.AT``)."""
    width, reach = len(features), max(*RECENT, *SUMMARY)
    extra = (features.index(mid), features.index(imbalance))

    def run(batches):
        halo, last = np.empty((0, width), np.float32), -1
        for batch in batches:
            if not batch.num_rows:
                continue
            place = rolling.in_order(batch.column(rolling.AT).to_numpy(), last)
            held = len(halo) if place[0] else 0  # rows before the batch, of the group that goes on
            x = np.concatenate([halo[len(halo) - held :], matrix(batch.column("now"))])
            found = []
            for a in range(0, len(place), VECTORS):
                own = place[a : a + VECTORS]
                at = np.arange(held + a, held + a + len(own))
                out = np.empty((len(own), len(RECENT) * width + 2 * len(SUMMARY)), np.float32)
                for k in RECENT:
                    out[:, k * width : (k + 1) * width] = x[at - np.minimum(own, k)]
                for j, k in enumerate(SUMMARY):
                    out[:, len(RECENT) * width + 2 * j : len(RECENT) * width + 2 * j + 2] = x[(at - np.minimum(own, k))[:, None], extra]
                found.append(function(batch.slice(a, len(own)), out))
            yield from pa.Table.from_batches(found).combine_chunks().to_batches()
            halo, last = x[len(x) - min(reach, int(place[-1]) + 1) :].copy(), place[-1]

    return packed(featured, features).mapInArrow(run, schema)


def packed(featured: DataFrame, features: list[str]) -> DataFrame:
    """The features as one array ``now`` beside the other columns: one column is far less to carry to Python than hundreds."""
    return featured.select(*(c for c in featured.columns if c not in features), F.array(*(F.col(c).cast("float") for c in features)).alias("now"))


def flatten_window(featured: DataFrame, features: list[str], length: int = 100, pad: str = "first") -> DataFrame:
    """``vector``: the features of the last ``length`` ticks, oldest first, padded on the left with the first tick or zeros."""
    packed = featured.withColumn("now", F.array(*(F.col(c).cast("float") for c in features)))
    rows = packed.selectExpr("*", f"collect_list(now) {w.frame(length)} AS held", f"{w.first('now')} AS oldest")
    filler = F.col("oldest") if pad == "first" else F.array_repeat(F.lit(0.0).cast("float"), len(features))
    return rows.withColumn("vector", F.flatten(F.concat(F.array_repeat(filler, F.lit(length) - F.size("held")), F.col("held")))).drop("now", "held", "oldest")


def last_rows(ticks: DataFrame) -> DataFrame:
    """Each group's last tick."""
    return ticks.selectExpr("*", f"row_number() OVER (PARTITION BY {', '.join(GROUP)} ORDER BY row_nr DESC) AS from_end").filter("from_end = 1").drop("from_end")
