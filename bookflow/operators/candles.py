"""Candles: open, high, low, close and volume of time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookflow.schema import GROUP


def candles(ticks: DataFrame, interval: int = 30, seconds: str = "tod", price: str = "n_midprice", amount: str = "amount_delta", keys: tuple[str, ...] = GROUP) -> DataFrame:
    """By group and bucket of ``interval`` seconds; ticks without a price give no open or close. Rows are counted from 0.

    Where a group has no times (all 0), buckets are counted in rows.
    """
    rows = ticks.withColumn("latest", F.max(seconds).over(Window.partitionBy(*keys)))
    bucket = F.when(F.coalesce(F.col("latest"), F.lit(0)) == 0, F.floor((F.col("row_nr") - 1) / interval)).otherwise(F.floor(F.col(seconds) / interval))
    index = F.col("row_nr") - 1
    known = F.when(F.col(price).isNotNull(), index)
    return rows.withColumn("bucket", bucket.cast("long")).groupBy(*keys, "bucket").agg(
        F.min_by(price, known).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, known).alias("close"), F.sum(amount).alias("volume"), F.min(index).alias("row_start"), F.max(index).alias("row_end"), F.count(F.lit(1)).alias("ticks")
    )


def numbered(found: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    return found.selectExpr("*", f"CAST(row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY bucket) - 1 AS INT) AS candle_idx")


def thinned(markers: DataFrame, most: int = 250, keys: tuple[str, ...] = GROUP, order: str = "row_nr") -> DataFrame:
    """Every ceil(n / most)-th marker of a group, in order, at most ``most``."""
    over = f"PARTITION BY {', '.join(keys)}"
    rows = markers.selectExpr("*", f"row_number() OVER ({over} ORDER BY {order}) - 1 AS place", f"count(*) OVER ({over}) AS markers")
    step = f"greatest(CAST(ceil(markers / {most}) AS INT), 1)"
    return rows.filter(f"place % {step} = 0 AND floor(place / {step}) < {most}").drop("place", "markers")


def long_enough(found: DataFrame, least: int = 5, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """Candles of the groups that have ``least`` of them."""
    return found.selectExpr("*", f"count(*) OVER (PARTITION BY {', '.join(keys)}) AS held").filter(f"held >= {least}").drop("held")


def approximate_candle(interval: int = 30, ticks_a_candle: int = 3) -> str:
    """The older place of a tick's marker: it takes a tick to last ``ticks_a_candle`` seconds, whatever the times say."""
    return f"CAST(floor((row_nr - 1) / greatest({interval} DIV {ticks_a_candle}, 1)) AS INT)"


def of_rows(rows: DataFrame, found: DataFrame, width: int = 4096, keys: tuple[str, ...] = GROUP, row: str = "row_nr") -> DataFrame:
    """Rows with ``candle_idx``, the candle whose first to last row hold them: of several the last one, NULL without any.

    An interval join by stretches of ``width`` rows: a candle is met in each stretch that it reaches into, so a row is compared
    with the candles around it only, and a group's rows spread over tasks.
    """
    start, end = F.floor(F.col("row_start") / width), F.floor(F.col("row_end") / width)
    reach = found.select(*keys, F.explode(F.sequence(start, end)).alias("__stretch"), "row_start", "row_end", F.col("candle_idx").alias("__candle"))
    at = F.col(row) - 1
    ours = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__stretch", F.floor(at / width))
    met = ours.join(reach, [*keys, "__stretch"], "left").withColumn("__candle", F.when(at.between(F.col("row_start"), F.col("row_end")), F.col("__candle")))
    grouped = met.groupBy(*keys, "__stretch", "__row").agg(*(F.first(c).alias(c) for c in rows.columns if c not in keys), F.max("__candle").alias("candle_idx"))
    return grouped.select(*rows.columns, "candle_idx")
