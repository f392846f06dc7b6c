"""Exact percentiles whose work stays spread: no task sees all distinct values."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sketches of this accuracy misplace a rank by one in so many; values within ``MARGIN`` such steps of a percentile are ordered.
ACCURACY = 100_000
MARGIN = 3


def exact_percentiles(df: DataFrame, column: str, fractions: list[float]) -> DataFrame:
    """One row: ``at``, the exact percentiles in the given order, interpolated between neighbours as ``percentile`` does.

    A sketch brackets each percentile. Values outside a bracket are only counted, inside tasks; those in it (a few in
    100,000, and repeated ones once) are put in order. NULL isn't a value; without values each percentile is NULL. A bracket that
    misses its percentile raises an error.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    step = MARGIN / ACCURACY
    edges = [min(max(f + side, 0.0), 1.0) for f in fractions for side in (-step, step)]
    around = values.agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", edges, ACCURACY).alias("cuts"))  # one sketch
    edge = [F.col("least") if f <= 0 else F.col("most") if f >= 1 else F.col("cuts")[k] for k, f in enumerate(edges)]
    brackets = around.select("n", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), edge[2 * k].alias("low"), edge[2 * k + 1].alias("high"), ((F.col("n") - 1) * float(f)).alias("position")) for k, f in enumerate(fractions)))).alias("b")).select("n", "b.*")
    side = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
    placed = values.crossJoin(F.broadcast(brackets.select("k", "low", "high"))).select("k", side.alias("side"), "v")  # a row for each fraction
    counts = placed.groupBy("k", "side", F.when(F.col("side") == 0, F.col("v")).alias("held")).agg(F.count(F.lit(1)).alias("times"), F.min("v").alias("least"), F.max("v").alias("most"))
    upto = counts.withColumn("upto", F.sum("times").over(Window.partitionBy("k").orderBy("side", "held").rowsBetween(Window.unboundedPreceding, 0)))
    of = lambda wanted, x: F.when(F.col("side") == wanted, F.col(x))
    ranks = {"under": F.floor("position"), "over": F.ceil("position")}
    ranked = upto.join(F.broadcast(brackets.select("k", "position")), "k").groupBy("k").agg(
        F.coalesce(F.sum(of(-1, "times")), F.lit(0)).alias("below"),
        F.max(of(-1, "most")).alias("before"),
        F.coalesce(F.sum(F.when(F.col("side") < 1, F.col("times"))), F.lit(0)).alias("end"),
        F.min(of(1, "least")).alias("after"),
        *(F.min(F.when((F.col("side") == 0) & (F.col("upto") > rank), F.col("held"))).alias(name) for name, rank in ranks.items()),
    )
    missed = F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")
    # A bracket's own rounding may leave a rank right beside it: that is the nearest value on that side.
    at = {name: F.when(F.col("n") == 0, None).when(rank == F.col("below") - 1, F.col("before")).when(rank == F.col("end"), F.col("after")).when((rank >= F.col("below")) & (rank < F.col("end")), F.col(name)).otherwise(missed) for name, rank in ranks.items()}
    part = F.col("position") - F.floor("position")
    found = brackets.join(F.broadcast(ranked), "k", "left").select("k", "position", *(x.alias(name) for name, x in at.items()))
    value = F.when(F.col("under") == F.col("over"), F.col("under")).otherwise(F.col("under") * (1 - part) + F.col("over") * part)
    return found.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", value.alias("value")))), lambda x: x["value"]).alias("at"))


#: Unlike values of a side that are put in order, about; wider brackets are narrowed first. Steps of a bracket's sketch.
ORDERED, STEPS = 100_000, 1_000


def top_values(rows: DataFrame, side: str, column: str, wanted: Callable[[int], int]) -> list[dict]:
    """By side (few of them): ``n``, and ``taken``, ``total``, ``low``, ``high`` of its ``wanted(n)`` largest values, exactly.

    A bracket of values holds the cut from the start. While more than ``ORDERED`` unlike values lie in it, a sketch of its rows
    proposes a narrower one, whose counts say on which side of it the cut lies, so each turn keeps about three of ``STEPS`` parts,
    and never loses the cut. The few values left are counted and put in order; values over the bracket are only added up, in
    tasks. NULL isn't a value.
    """
    values = rows.select(F.col(side).cast("string").alias("side"), F.col(column).cast("double").alias("v")).filter("v IS NOT NULL").persist()  # read once a turn
    try:
        return _top_values(values, wanted)
    finally:
        values.unpersist()


def _ends(held: DataFrame) -> list:
    """(side, value, times) of what brackets hold: about ORDERED values a side."""
    return held.filter("v BETWEEN low AND high").groupBy("side", "v").count().collect()


def _top_values(values: DataFrame, wanted: Callable[[int], int]) -> list[dict]:
    spark = values.sparkSession
    found = {r["side"]: r.asDict() for r in values.groupBy("side").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.approx_count_distinct("v").alias("unlike")).collect()}
    for r in found.values():
        r |= {"wanted": wanted(r["n"]), "inside": r["n"], "over": 0}

    def within(sides: dict[str, tuple[float, float]]) -> DataFrame:
        brackets = spark.createDataFrame([(s, *b) for s, b in sides.items()], "side string, low double, high double")
        return values.join(F.broadcast(brackets), values["side"].eqNullSafe(brackets["side"])).select(values["side"], "v", "low", "high")  # a row a side

    def counts(sides: dict[str, tuple[float, float]]) -> dict:
        held = within(sides).groupBy("side").agg(F.expr("count_if(v > high)").alias("over"), F.expr("count_if(v BETWEEN low AND high)").alias("inside"), F.expr("count_if(v >= low)").alias("upto"), F.expr("approx_count_distinct(CASE WHEN v BETWEEN low AND high THEN v END)").alias("unlike"))
        return {r["side"]: r for r in held.collect()}

    while open_ := {s: (r["low"], r["high"]) for s, r in found.items() if r["unlike"] > ORDERED and r["low"] < r["high"]}:
        sketches = within(open_).filter("v BETWEEN low AND high").groupBy("side").agg(F.percentile_approx("v", F.array(*(F.lit(k / STEPS) for k in range(STEPS + 1))), 10 * STEPS).alias("cuts"))
        tried = {}
        for s, cuts in sketches.collect():
            r = found[s]
            at = (1 - (r["wanted"] - r["over"]) / r["inside"]) * STEPS
            low, high = cuts[max(0, int(at) - 1)], cuts[min(STEPS, int(at) + 2)]
            if (low, high) == (r["low"], r["high"]):  # a few values fill it: halve its range
                low = low / 2 + high / 2
                if low in (r["low"], r["high"]):
                    low = high
            tried[s] = (low, high)
        missed = {}
        for s, c in counts(tried).items():
            r, (low, high) = found[s], tried[s]
            if c["over"] >= r["wanted"]:
                missed[s] = (math.nextafter(high, math.inf), r["high"])
            elif c["upto"] < r["wanted"]:
                missed[s] = (r["low"], math.nextafter(low, -math.inf))
            r |= dict(zip(("low", "high"), missed.get(s, (low, high)))) | {k: c[k] for k in ("over", "inside", "unlike")}
        for s, c in counts(missed).items() if missed else ():
            found[s] |= {k: c[k] for k in ("over", "inside", "unlike")}
    out = []
    held = within({s: (r["low"], r["high"]) for s, r in found.items()})
    above = {r["side"]: r for r in held.filter("v > high").groupBy("side").agg(F.sum("v").alias("total"), F.max("v").alias("most")).collect()}
    ends: dict = {s: [] for s in found}
    for s, v, times in _ends(held):
        ends[s].append((v, times))
    for s, r in found.items():
        left, low, more = r["wanted"] - r["over"], None, 0.0
        for v, times in sorted(ends[s], reverse=True):
            if left <= 0:
                break
            taken = min(left, times)
            low, more, left = v, more + v * taken, left - taken
        top = above[s]["most"] if s in above else max(ends[s])[0]
        out.append({"side": s, "n": r["n"], "taken": r["wanted"], "total": more + (above[s]["total"] if s in above else 0.0), "low": low, "high": top})
    return out
