"""Training samples: limit and history filters, splits, class and profit weights, endpoints, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.functions import windows as w
from bookflow.functions.exprs import at_limit, clip
from bookflow.schema import GROUP, HORIZONS


def with_targets(ticks: DataFrame, price: str = "n_midprice") -> DataFrame:
    """Future price changes by horizon, 0 past the group's end, and the tick's place in its group."""
    return ticks.selectExpr("*", *(f"coalesce({w.lead(price, h)} - {price}, 0D) AS price_diff_{h}" for h in HORIZONS), f"{w.row_index()} AS local_idx")


def emit(targeted: DataFrame, min_history: int = 4, keep_limits: bool = False) -> DataFrame:
    """Rows that become samples: after windows are computed, limit ticks and each group's first ticks go."""
    rows = targeted.filter(F.col("local_idx") >= min_history)
    return rows if keep_limits else rows.filter(f"NOT {at_limit()}")


def split_by_date(rows: DataFrame, first_validation: int) -> DataFrame:
    return rows.withColumn("split", F.when(F.col("date") < first_validation, "train").otherwise("val"))


def split_by_index(rows: DataFrame, test_size: float = 0.2) -> DataFrame:
    """The first part of the files in the order (date, session, sym) trains. Files are counted, rows aren't moved but by key."""
    files = rows.select("date", "session", "sym").distinct()
    ranked = files.selectExpr("*", "row_number() OVER (ORDER BY date, session, sym) AS nr", "count(*) OVER () AS files")
    parts = ranked.select("date", "session", "sym", F.when(F.col("nr") <= F.floor(F.col("files") * (1 - test_size)), "train").otherwise("val").alias("split"))
    return rows.join(parts, ["date", "session", "sym"])


def class_weights(rows: DataFrame, label: str = "label", classes: int = 3) -> DataFrame:
    """total / (classes that occur * count); 1 for a class that doesn't occur."""
    counts = rows.agg(*(F.count_if(F.col(label) == k).alias(f"c{k}") for k in range(classes)))
    occurring = sum((F.when(F.col(f"c{k}") > 0, 1).otherwise(0) for k in range(1, classes)), F.when(F.col("c0") > 0, 1).otherwise(0))
    total = sum((F.col(f"c{k}") for k in range(1, classes)), F.col("c0"))
    rows_out = [F.struct(F.lit(k).alias("label"), F.col(f"c{k}").alias("n"), F.when(F.col(f"c{k}") > 0, total / (occurring * F.col(f"c{k}"))).otherwise(1.0).alias("weight")) for k in range(classes)]
    return counts.select(F.explode(F.array(*rows_out)).alias("r")).select("r.*")


def mean_move(rows: DataFrame, column: str = "price_diff") -> DataFrame:
    return rows.agg(F.coalesce(F.avg(F.abs(F.col(column))), F.lit(0.0)).alias("mean_move"))


def profit_weights(rows: DataFrame, base: float = 1.0, alpha: float = 1.0, low: float = 0.5, high: float = 3.0, label: str = "label", column: str = "price_diff", training: DataFrame | None = None) -> DataFrame:
    """Class weight times a clipped weight of the move; both tables that are joined have at most three rows. Counts and the mean
    move are those of ``training``, if other rows are weighted along."""
    known = rows if training is None else training
    weights = class_weights(known, label).select(F.col("label").alias(label), F.col("weight").alias("class_weight"))
    joined = rows.join(F.broadcast(weights), label, "left").crossJoin(F.broadcast(mean_move(known, column)))
    scaled = clip(f"{base!r} + {alpha!r} * abs({column}) / (mean_move + 1e-10)", low, high)
    return joined.withColumn("weight", F.expr(f"{scaled} * coalesce(class_weight, 1D)"))


def endpoints(ticks: DataFrame, window: int = 100, horizon: int = 60, stride: int = 1, most: int | None = None) -> DataFrame:
    """Ticks that end a full window and have the whole horizon ahead, each ``stride``-th, at most ``most`` a group."""
    over = f"PARTITION BY {', '.join(GROUP)}"
    rows = ticks.selectExpr("*", f"{w.row_index()} AS idx", f"count(*) OVER ({over}) AS group_rows")
    rows = rows.filter(f"idx >= {window - 1} AND idx < group_rows - {horizon} AND pmod(idx - {window - 1}, {stride}) = 0")
    return rows if most is None else rows.filter(f"(idx - {window - 1}) / {stride} < {most}")


def label_totals(rows: DataFrame, label: str = "label", classes: int = 3) -> DataFrame:
    return class_weights(rows, label, classes).select("label", "n")


def lone_windows(ticks: DataFrame, length: int = 100, stride: int | None = None) -> DataFrame:
    """Every window of ``length`` ticks as a session of its own, as a model meets it that is given one window alone.

    A tick is repeated for each window that holds it: windows end at each ``stride``-th tick (``length`` if none is given, so
    each tick is in one window), the first at tick ``length``. ``session`` numbers the window within the instrument's day,
    ``window_end`` is its last tick's place in the group (from 0), ``row_nr`` counts within the window; features over the
    result see no tick outside of it. Groups shorter than a window have none.
    """
    stride, over = stride or length, f"PARTITION BY {', '.join(GROUP)}"
    rows = ticks.selectExpr("* EXCEPT (row_nr)", f"{w.row_index()} AS __idx", f"count(*) OVER ({over}) AS __n")
    first = f"CAST(ceil(greatest(__idx - {length - 1}, 0) / {stride}) AS BIGINT)"
    last = f"CAST(floor((least(__idx + {length - 1}, __n - 1) - {length - 1}) / {stride}) AS BIGINT)"
    rows = rows.selectExpr("*", f"{first} AS __first", f"{last} AS __last").filter("__last >= __first AND __n >= " + str(length))
    held = rows.selectExpr("*", f"explode(transform(sequence(__first, __last), k -> k * {stride} + {length - 1})) AS window_end")
    numbered = held.selectExpr("* EXCEPT (session)", "session * 1099511627776L + window_end AS session", f"CAST(__idx - window_end + {length} AS INT) AS row_nr")
    return numbered.drop("__idx", "__n", "__first", "__last")
