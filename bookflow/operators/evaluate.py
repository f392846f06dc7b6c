"""Scoring of signals: sweeps over thresholds and ratios, confusion matrices, reports, PnL statistics.

Input rows have ``down``, ``flat``, ``up`` (probabilities), ``y_true`` (0, 1, 2) and ``price_diff``. A sweep explodes rows by
the handful of settings and aggregates in the same task, so that only one row for each setting and task is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookflow.operators import signals
from bookflow.operators.quantile import exact_percentiles, top_values

#: Fixed value: mean PnL that the official score takes off.
BASELINE = 0.0004


def f05(precision: Column, recall: Column) -> Column:
    return 1.25 * precision * recall / (0.25 * precision + recall + 1e-10)


def official_score(f: Column, avg_pnl: Column, baseline: float = BASELINE) -> Column:
    gain = avg_pnl - baseline
    return f * gain * F.abs(gain) * 10000


def measures(rows: DataFrame, *keys: str, floor_moves: bool = True, times: str | None = None) -> DataFrame:
    """Rows with ``signal``, ``y_true``, ``price_diff`` to the standard measures by key; zeros where there is no signal.
    ``times``: a column of how many rows each one stands for, ``price_diff`` being their sum."""
    count_if = lambda x: F.count_if(x) if times is None else F.sum(F.when(x, F.col(times)).otherwise(0))
    active = F.col("signal").isin(0, 2)
    earned = signals.pnl(F.col("signal"), F.col("price_diff"))
    sums = rows.groupBy(*keys).agg(
        count_if(F.lit(True)).alias("n"),
        count_if(active).alias("trades"),
        count_if(active & (F.col("signal") == F.col("y_true"))).alias("correct"),
        count_if(F.col("y_true").isin(0, 2)).alias("moves"),
        F.sum(F.when(active, earned).otherwise(0.0)).alias("total_pnl"),
    )
    zero = F.lit(0.0)
    moves = F.greatest("moves", F.lit(1)) if floor_moves else F.col("moves")
    out = sums.withColumns({"signal_pct": F.coalesce(F.try_divide("trades", "n"), zero), "precision": F.coalesce(F.try_divide("correct", "trades"), zero), "recall": F.coalesce(F.try_divide(F.col("correct"), moves), zero), "avg_pnl": F.coalesce(F.try_divide("total_pnl", "trades"), zero)})
    out = out.withColumn("f05", f05(F.col("precision"), F.col("recall")))
    return out.withColumn("official_score_est", official_score(F.col("f05"), F.col("avg_pnl")))


def threshold_sweep(scores: DataFrame, thresholds=signals.THRESHOLDS) -> DataFrame:
    rows = scores.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    rule = signals.threshold_rule(F.col("down"), F.col("flat"), F.col("up"), F.col("threshold"))
    return measures(rows.select("threshold", "y_true", "price_diff", rule.alias("signal")), "threshold")


def best(rows: DataFrame, metric: str, *order: str) -> DataFrame:
    """The first row, in the given order, of those with the largest metric. The rows are settings: a few hundred at most."""
    rank = F.row_number().over(Window.orderBy(F.desc(F.col(metric) + 0.0), *order))
    return rows.withColumn("place", rank).filter("place = 1").drop("place")


def ratio_values(low: float = 0.5, high: float = 1.0, step: float = 0.02) -> list[float]:
    return sorted({round(low + k * step, 6) for k in range(round((high - low) / step) + 1)})


def ratio_grid(scores: DataFrame, values: list[float] | None = None) -> DataFrame:
    """The measures of every pair of ratios. Probabilities aren't negative.

    At a down ratio a row's signal is down or flat while the up ratio is small, and up from some up ratio on. So a row meets
    the down ratios only, and is counted by where it turns; each count then meets the up ratios.
    """
    values = values or ratio_values()
    every = F.array(*(F.lit(v) for v in values))
    rows = scores.select("*", F.explode(every).alias("down_ratio")).withColumn("weighed", F.col("down") * F.col("down_ratio"))
    falls = F.coalesce(F.col("weighed") >= F.col("flat"), F.lit(False))
    rows = rows.select("down_ratio", "y_true", "price_diff", "up", F.when(falls, 0).otherwise(1).alias("before"), F.when(falls, F.col("weighed")).otherwise(F.col("flat")).alias("held"))
    turn = sum((F.coalesce((F.col("up") * v <= F.col("held")).cast("int"), F.lit(0)) for v in sorted(values)), F.lit(0))
    counts = rows.groupBy("down_ratio", "y_true", "before", turn.alias("turn")).agg(F.count(F.lit(1)).alias("times"), F.sum("price_diff").alias("price_diff"))
    pairs = counts.select("*", F.posexplode(F.array(*(F.lit(v) for v in sorted(values)))).alias("at", "up_ratio"))
    signal = F.when(F.col("at") < F.col("turn"), F.col("before")).otherwise(2)
    return measures(pairs.select("down_ratio", "up_ratio", "y_true", "price_diff", "times", signal.alias("signal")), "down_ratio", "up_ratio", times="times")


def legacy_scan(scores: DataFrame, thresholds=signals.THRESHOLDS) -> DataFrame:
    """The older training scan: a row over the threshold on both sides counts twice."""
    rows = scores.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    over = lambda c: F.count_if(F.col(c) > F.col("threshold"))
    right = F.count_if((F.col("down") > F.col("threshold")) & (F.col("y_true") == 0)) + F.count_if((F.col("up") > F.col("threshold")) & (F.col("y_true") == 2))
    return rows.groupBy("threshold").agg((over("down") + over("up")).alias("signals"), right.alias("correct"))


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """All nine cells (true, predicted) by key, absent ones 0; values out of range are ignored."""
    counts = rows.groupBy(*keys).agg(*(F.count_if((F.col("y_true") == t) & (F.col("signal") == p)).alias(f"c{t}{p}") for t in range(3) for p in range(3)))
    cells = counts.select(*keys, F.explode(F.array(*(F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("signal"), F.col(f"c{t}{p}").alias("n")) for t in range(3) for p in range(3)))).alias("r"))
    return cells.select(*keys, "r.*")


def class_report(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, then accuracy, macro and weighted means; empty denominators give 0."""
    c = rows.agg(*(F.count_if((F.col("y_true") == t) & (F.col("signal") == p)).cast("double").alias(f"c{t}{p}") for t in range(3) for p in range(3)))
    zero = F.lit(0.0)
    cell = lambda t, p: F.col(f"c{t}{p}")
    per = []
    for k in range(3):
        support, called = sum((cell(k, p) for p in range(3)), zero), sum((cell(t, k) for t in range(3)), zero)
        precision, recall = F.coalesce(F.try_divide(cell(k, k), called), zero), F.coalesce(F.try_divide(cell(k, k), support), zero)
        per.append((precision, recall, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero), support))
    total = sum((s for *_, s in per), zero)
    hits = cell(0, 0) + cell(1, 1) + cell(2, 2)
    row = lambda name, p, r, f, n: F.struct(F.lit(name).alias("name"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.alias("support"))
    accuracy = F.coalesce(F.try_divide(hits, total), zero)
    macro = [sum((x[k] for x in per), zero) / 3 for k in range(3)]
    mean = [F.coalesce(F.try_divide(sum((x[k] * x[3] for x in per), zero), total), zero) for k in range(3)]
    rows_out = [row(str(k), *per[k]) for k in range(3)] + [row("accuracy", accuracy, accuracy, accuracy, total), row("macro", *macro, total), row("weighted", *mean, total)]
    return c.select(F.explode(F.array(*rows_out)).alias("r")).select("r.*")


def report_text(title: str, threshold: float, report: DataFrame, cells: DataFrame) -> str:
    """A class report and a confusion matrix (a row a class each) as plain text."""
    names = {"0": "down", "1": "flat", "2": "up"}
    by_name = {r["name"]: r for r in report.collect()}
    count = {(r["y_true"], r["signal"]): r["n"] for r in cells.collect()}
    out = [f"{title}, threshold {threshold:g}", "", f"{'':>10}{'precision':>11}{'recall':>11}{'f1':>11}{'support':>11}"]
    for name in ("0", "1", "2", "macro", "weighted"):
        r = by_name[name]
        out.append(f"{names.get(name, name):>10}{r['precision']:>11.4f}{r['recall']:>11.4f}{r['f1']:>11.4f}{r['support']:>11.0f}")
    out += ["", f"accuracy {by_name['accuracy']['precision']:.4f}", "", f"{'true':>10}" + "".join(f"{n:>11}" for n in names.values())]
    return "\n".join(out + [f"{n:>10}" + "".join(f"{count.get((t, p), 0):>11}" for p in range(3)) for t, n in enumerate(names.values())]) + "\n"


def direction_purity(rows: DataFrame) -> DataFrame:
    """Of the signals on real moves, the part with the right direction; NULL without any."""
    moved = F.col("signal").isin(0, 2) & F.col("y_true").isin(0, 2)
    return rows.agg(F.count_if(moved).alias("directional"), F.try_divide(F.count_if(moved & (F.col("signal") == F.col("y_true"))).cast("double"), F.count_if(moved)).alias("purity"))


def confusion_diff(ours: DataFrame, reference: DataFrame, *keys: str) -> DataFrame:
    """Accuracies, difference of samples and sum of absolute differences of the cells, by key."""
    both = ours.withColumnRenamed("n", "ours").join(reference.withColumnRenamed("n", "theirs"), [*keys, "y_true", "signal"], "full").na.fill(0, ["ours", "theirs"])
    hit = F.col("y_true") == F.col("signal")
    return both.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(hit, F.col("ours")).otherwise(0)).cast("double"), F.sum("ours")).alias("accuracy"),
        F.try_divide(F.sum(F.when(hit, F.col("theirs")).otherwise(0)).cast("double"), F.sum("theirs")).alias("reference_accuracy"),
        (F.sum("ours") - F.sum("theirs")).alias("sample_diff"),
        F.sum(F.abs(F.col("ours") - F.col("theirs"))).alias("cell_diff"),
    )


def reference_cells(matrices: DataFrame, value: str = "value") -> DataFrame:
    """Published matrices, JSON of label, split and three rows of three counts, as cells (label, split, y_true, signal, n)."""
    labels = matrices.select(F.explode(F.from_json(value, "map<string, map<string, array<array<bigint>>>>")).alias("label", "splits"))
    splits = labels.select("label", F.explode("splits").alias("split", "matrix"))
    lines = splits.select("label", "split", F.posexplode("matrix").alias("y_true", "line"))
    return lines.select("label", "split", "y_true", F.posexplode("line").alias("signal", "n"))


def pnl_stats(rows: DataFrame, column: str = "pnl") -> DataFrame:
    stats = rows.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return stats.crossJoin(F.broadcast(exact_percentiles(rows, column, [0.5]))).select("n", "low", "high", "mean", F.col("at")[0].alias("median"), "std")


def top_percent(rows: DataFrame, percent: float, side: str = "signal", column: str = "pnl") -> DataFrame:
    """The best percent of trades (one at least) by side, and over all sides (``all``); see :func:`quantile.top_values`."""
    both = rows.select(F.explode(F.array(F.col(side).cast("string"), F.lit("all"))).alias("side"), F.col(column).alias("pnl"))
    found = top_values(both, "side", "pnl", lambda n: max(math.floor(n * percent / 100), 1))
    out = [(r["side"], r["taken"], r["total"] / r["taken"], r["total"], r["low"], r["high"]) for r in found]
    return rows.sparkSession.createDataFrame(out, "side string, trades long, mean double, total double, low double, high double")


def drawdown(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The deepest fall of summed PnL under its peak by key; the peak starts at 0.

    Keys with very many trades stay parallel: the order is cut into stretches, each gives its sum, its highest and lowest
    running sum and its own deepest fall, and these few rows are combined.
    """
    path = Window.partitionBy(*keys, "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    equity = trades.withColumn("equity", F.sum("pnl").over(path))
    peak = equity.withColumn("peak", F.greatest(F.max("equity").over(path), F.lit(0.0)))
    parts = peak.groupBy(*keys, "stretch").agg(F.sum("pnl").alias("sum"), F.max("peak").alias("top"), F.min("equity").alias("bottom"), F.min(F.least(F.col("equity") - F.col("peak"), F.lit(0.0))).alias("fall"))
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0.0)))
    tops = based.withColumn("high", F.greatest(F.coalesce(F.max(F.col("base") + F.col("top")).over(before), F.lit(0.0)), F.lit(0.0)))
    return tops.groupBy(*keys).agg(F.min(F.least(F.col("fall"), F.col("base") + F.least(F.col("bottom"), F.lit(0.0)) - F.col("high"))).alias("max_drawdown"))


def signal_summary(rows: DataFrame, key: str = "horizon") -> DataFrame:
    """By horizon: measures, win rate, mean win and loss (no gain is a loss). Recall isn't floored here."""
    base = measures(rows, key, floor_moves=False)
    active = F.col("signal").isin(0, 2)
    earned = signals.pnl(F.col("signal"), F.col("price_diff"))
    zero = F.lit(0.0)
    more = rows.groupBy(key).agg(
        F.coalesce(F.try_divide(F.count_if(active & (earned > 0)).cast("double"), F.count_if(active)), zero).alias("win_rate"),
        F.coalesce(F.avg(F.when(active & (earned > 0), earned)), zero).alias("avg_win"),
        F.coalesce(F.avg(F.when(active & (earned <= 0), earned)), zero).alias("avg_loss"),
    )
    return base.join(more, key)
