"""Data-quality profiles of tick tables. Each is one aggregation: a scan, partial sums in every task, one small shuffle."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions import windows as w
from bookflow.functions.exprs import direction, mid_price
from bookflow.operators.quantile import exact_percentiles
from bookflow.schema import ALPHA, GROUP, HORIZONS, LEVELS

#: Buckets of rows that are compared by digests.
BUCKETS = 4096


def ratio(part: Column, whole: Column) -> Column:
    """Rounded half to even at four places; 0 of nothing is NULL."""
    return F.bround(F.try_divide(part.cast("double"), whole), 4)


def unpivot(row: DataFrame, columns: list[str], fields: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Each row's ``<column>__<field>`` values to a row for each column, beside the row's ``by``."""
    rows = [F.struct(F.lit(c).alias("column"), *(F.col(f"{c}__{f}").alias(f) for f in fields)) for c in columns]
    return row.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    row = df.agg(*(x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), ratio(F.count_if(F.col(c).isNull()), n).alias(f"{c}__null_ratio"))))
    return unpivot(row, columns, ["nulls", "null_ratio"])


def missing_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return null_profile(df, columns).filter("null_ratio > 0").orderBy(F.desc("null_ratio"), "column")


def infinite_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*(F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"{c}__infinite") for c in columns))
    return unpivot(row, columns, ["infinite"])


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first of each distinct row. Rows are compared by their values, grouped with partial counts."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by each key on its own, in one pass over the rows."""
    sets = df.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("set"))
    value = F.coalesce(*(F.col(k).cast("string") for k in keys))
    name = F.lit(None).cast("string")
    for position, k in enumerate(keys):
        own = (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - position))
        name = F.when(F.col("set") == own, k).otherwise(name)
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def monotonic_time(ticks: DataFrame, time: str = "tod") -> DataFrame:
    """Whether time never falls within each group, in row order."""
    before = ticks.selectExpr("*", f"{w.lag(time)} AS time_before")
    return before.groupBy(*GROUP).agg(F.coalesce(F.bool_and(F.coalesce(F.col(time) >= F.col("time_before"), F.lit(True))), F.lit(True)).alias("monotonic"), F.count(F.lit(1)).alias("ticks"))


def crossed_book(ticks: DataFrame) -> DataFrame:
    """Ticks whose best bid lies over the ask, by level; missing prices count as not crossed."""
    n = F.count(F.lit(1))
    row = ticks.agg(*(x for i in LEVELS for x in (F.count_if(F.col(f"n_bid{i}") > F.col(f"n_ask{i}")).alias(f"{i}__crossed"), ratio(F.count_if(F.col(f"n_bid{i}") > F.col(f"n_ask{i}")), n).alias(f"{i}__crossed_ratio"))))
    return unpivot(row, [str(i) for i in LEVELS], ["crossed", "crossed_ratio"]).withColumnRenamed("column", "level")


def level_inversion(ticks: DataFrame) -> DataFrame:
    """Deeper levels that are priced better than the level before."""
    row = ticks.agg(*(x for i in LEVELS[1:] for x in (F.count_if(F.col(f"n_bid{i}") > F.col(f"n_bid{i - 1}")).alias(f"{i}__bid_inverted"), F.count_if(F.col(f"n_ask{i}") < F.col(f"n_ask{i - 1}")).alias(f"{i}__ask_inverted"))))
    return unpivot(row, [str(i) for i in LEVELS[1:]], ["bid_inverted", "ask_inverted"]).withColumnRenamed("column", "level")


def negative_sizes(ticks: DataFrame, columns: list[str]) -> DataFrame:
    """Denominator: values that are there."""
    row = ticks.agg(*(x for c in columns for x in (F.count_if(F.col(c) < 0).alias(f"{c}__negative"), F.count(c).alias(f"{c}__known"), ratio(F.count_if(F.col(c) < 0), F.count(c)).alias(f"{c}__negative_ratio"))))
    return unpivot(row, columns, ["negative", "known", "negative_ratio"])


def outliers(df: DataFrame, columns: list[str], z: float = 5.0) -> DataFrame:
    """Values further than z population deviations from the mean. The statistics are one row, whatever the table's size."""
    stats = df.agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_avg"), F.stddev_pop(c).alias(f"{c}_dev"))))
    joined = df.select(*columns).crossJoin(F.broadcast(stats))
    row = joined.agg(*(x for c in columns for x in (F.count_if(F.abs(F.col(c) - F.col(f"{c}_avg")) > z * F.col(f"{c}_dev")).alias(f"{c}__outliers"), F.min(c).alias(f"{c}__low"), F.max(c).alias(f"{c}__high"))))
    return unpivot(row, columns, ["outliers", "low", "high"])


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, exact median, deviation and range of a column, one row."""
    stats = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("low"), F.max(column).alias("high"))
    return stats.crossJoin(F.broadcast(exact_percentiles(df, column, [0.5]))).select("n", "mean", F.col("at")[0].alias("median"), "std", "low", "high")


def midprice_rows(ticks: DataFrame) -> DataFrame:
    """Recorded against computed mid prices, tick by tick; missing sides count as 0."""
    rows = ticks.selectExpr("*", f"{mid_price('coalesce(n_bid1, 0)', 'coalesce(n_ask1, 0)')} AS calc_midprice")
    return rows.selectExpr("*", "abs(n_midprice - calc_midprice) AS abs_diff", "coalesce(abs(n_midprice - calc_midprice) > 1e-8, false) AS mismatch")


def midprice_summary(ticks: DataFrame) -> DataFrame:
    known = F.col("n_midprice").isNotNull() | F.col("calc_midprice").isNotNull()
    return midprice_rows(ticks).agg(F.count_if(known).alias("checked"), F.count_if("mismatch").alias("mismatches"), ratio(F.count_if("mismatch"), F.count_if(known)).alias("mismatch_ratio"), F.max("abs_diff").alias("max_diff"), F.avg("abs_diff").alias("mean_diff"))


def with_labels(ticks: DataFrame, price: str = "n_midprice") -> DataFrame:
    """Direction labels of every horizon from future prices; NULL past the group's end."""
    return ticks.selectExpr("*", *(f"{direction(f'{w.lead(price, h)} - {price}', ALPHA[h])} AS label_{h}" for h in HORIZONS))


def label_direction(labelled: DataFrame, price: str = "n_midprice", by: tuple[str, ...] = ()) -> DataFrame:
    """By horizon, and by the columns ``by`` (a file's are GROUP): how often a label agrees with the future and with the past
    move, and which agrees more by the rounded ratios."""
    exprs = [f"{direction(f'{w.lead(price, h)} - {price}', ALPHA[h])} AS future_{h}" for h in HORIZONS] + [f"{direction(f'{price} - {w.lag(price, h)}', ALPHA[h])} AS past_{h}" for h in HORIZONS]
    rows = labelled.selectExpr("*", *exprs)
    aggs = [x for h in HORIZONS for side in ("future", "past") for x in (F.count_if(F.col(f"label_{h}") == F.col(f"{side}_{h}")).alias(f"{h}__{side}_match"), F.count_if(F.col(f"label_{h}").isNotNull() & F.col(f"{side}_{h}").isNotNull()).alias(f"{h}__{side}_total"))]
    long = unpivot(rows.groupBy(*by).agg(*aggs), [str(h) for h in HORIZONS], ["future_match", "future_total", "past_match", "past_total"], by).withColumnRenamed("column", "horizon")
    rated = long.withColumns({f"{s}_ratio": ratio(F.col(f"{s}_match"), F.col(f"{s}_total")) for s in ("future", "past")})
    better = F.when(F.col("future_ratio") > F.col("past_ratio"), "future").when(F.col("future_ratio") < F.col("past_ratio"), "past").otherwise("tie")
    return rated.withColumn("better", better)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of each value, NULL among them. The total is summed from the counts, not from the rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.try_divide(F.col("n").cast("double"), F.col("total")).alias("share"))


def pivot_counts(df: DataFrame, key: str, column: str, values: list) -> DataFrame:
    """Counts of each value by key, missing ones 0. The values are given, so no job looks for them."""
    return df.groupBy(key).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def histogram(df: DataFrame, column: str, bins: int = 80) -> DataFrame:
    """Equal-width bins from the least to the largest value; the largest falls in the last bin."""
    edges = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    placed = df.filter(F.col(column).isNotNull()).select(column).crossJoin(F.broadcast(edges))
    number = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)))
    return placed.groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def clipped(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows between two exact percentiles, both included."""
    cut = exact_percentiles(df, column, [low, high]).withColumnRenamed("at", "__cut")
    return df.crossJoin(F.broadcast(cut)).filter(F.col(column).between(F.col("__cut")[0], F.col("__cut")[1])).drop("__cut")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair, over rows that have both; NULL where a column doesn't vary among them.

    A task adds up products of its rows as matrices (X'X and the like, with a matrix of which values are known), a row for each
    column and task is summed, and the pairs are made from the sums: nothing but matrices of ``columns`` squared, however many
    rows. Values are taken about the columns' means, so that no digits are lost.
    """
    width = len(columns)
    centre = df.agg(*(F.coalesce(F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))), F.lit(0.0)).alias(f"m{k}") for k, c in enumerate(columns))).first()
    means = np.array([float(v) for v in centre])

    def sums(batches):
        n, x1, x2, xy = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_pandas().to_numpy(float) for c in batch.columns]) - means
            known = (~np.isnan(x)).astype(float)
            x = np.where(known > 0, x, 0.0)
            n += known.T @ known
            x1 += x.T @ known  # sums of the row's column where the other is known too
            x2 += (x * x).T @ known
            xy += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)), pa.array(np.tile(np.arange(width), width)), *(pa.array(v.ravel()) for v in (n, x1, x2, xy))], names=["i", "j", "n", "x1", "x2", "xy"])

    parts = df.select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns))).mapInArrow(sums, "i long, j long, n double, x1 double, x2 double, xy double")
    total = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "x1", "x2", "xy")))
    other = total.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("x1").alias("y1"), F.col("x2").alias("y2"))
    pairs = df.sparkSession.range(width * width).select(F.floor(F.col("id") / width).alias("i"), (F.col("id") % width).alias("j")).filter("i < j")
    both = pairs.join(total.join(other, ["i", "j"]), ["i", "j"], "left")
    spread = lambda s1, s2: F.col(s2) - F.col(s1) * F.col(s1) / F.col("n")
    product = spread("x1", "x2") * spread("y1", "y2")
    name = F.array(*(F.lit(c) for c in columns))
    return both.select(name[F.col("i").cast("int")].alias("a"), name[F.col("j").cast("int")].alias("b"), F.when((F.col("n") > 1) & (product > 0), (F.col("xy") - F.col("x1") * F.col("y1") / F.col("n")) / F.sqrt(F.when(product > 0, product))).alias("corr"))


def missing_combinations(df: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected combinations without a row: an anti-join against the distinct keys."""
    return expected.join(df.select(*keys).distinct(), keys, "left_anti")


def file_rows(raw: DataFrame, kept: DataFrame, key: str = "source_file") -> DataFrame:
    """Rows read and kept by file."""
    a = raw.groupBy(key).agg(F.count(F.lit(1)).alias("raw_rows"))
    b = kept.groupBy(key).agg(F.count(F.lit(1)).alias("kept_rows"))
    kept_rows = F.coalesce("kept_rows", F.lit(0))
    return a.join(b, key, "left").select(key, "raw_rows", kept_rows.alias("kept_rows"), (F.col("raw_rows") - kept_rows).alias("dropped_rows"), F.when(kept_rows == 0, "empty").otherwise("ok").alias("status"))


def feature_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing and infinite values over all features, and whether labels or keys have leaked into them."""
    nulls = sum((F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in columns[1:]), F.count_if(F.col(columns[0]).isNull() | F.isnan(F.col(columns[0]).cast("double"))))
    infinite = sum((F.count_if(F.abs(F.col(c).cast("double")) == float("inf")) for c in columns[1:]), F.count_if(F.abs(F.col(columns[0]).cast("double")) == float("inf")))
    leaks = [c for c in columns if c.startswith("label") or c in ("time", "source_file")]
    return df.agg(nulls.alias("missing"), infinite.alias("infinite"), F.lit(len(leaks)).alias("leaks"))


def digests(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """By bucket of keys: rows and sums of two hashes of them, 128 bits. Tasks sum their own rows; a row for each bucket and task is dealt."""
    told = [x for c in (*keys, *columns) for x in (F.col(c), F.col(c).isNull())]  # a hash passes over NULL, so it is told where one is
    hashed = rows.select(_bucket(keys).alias("bucket"), F.xxhash64(*told).alias("a"), F.xxhash64(F.lit("again"), *reversed(told)).alias("b"))
    halves = [half for h in ("a", "b") for half in (F.shiftright(h, 32), F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)))]
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.array(*(F.sum(half) for half in halves)).alias("digest"))


def _bucket(keys: list[str]) -> Column:
    """A bucket's number, NULL for rows without a whole key, which agree with none."""
    return F.when(~reduce(or_, (F.col(k).isNull() for k in keys)), F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(BUCKETS)))


def compare_tables(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """By column that isn't a key: rows that agree (NULL agrees with NULL, NaN with NaN), that differ, that only one side has.

    Keys name rows. Both tables are read whole: buckets whose rows have the same digests on both sides agree, and only the rows of others
    are dealt and joined on their keys. Tables of the same rows give 0 but for ``equal``, and deal none.
    """
    columns = [c for c in ours.columns if c not in keys]
    one, other = (digests(t, keys, columns).select("bucket", F.struct("rows", "digest").alias(n)) for t, n in ((ours, "one"), (theirs, "other")))
    met = one.join(other, "bucket", "full").withColumn("agrees", F.coalesce(F.col("bucket").isNotNull() & (F.col("one") == F.col("other")), F.lit(False)))
    agreed = met.filter("agrees").agg(F.coalesce(F.sum("one.rows"), F.lit(0)).alias("__agreed"))
    odd = met.filter("NOT agrees").select(F.col("bucket").alias("__bucket")).distinct()  # BUCKETS and one at most
    left, right = (t.join(F.broadcast(odd), _bucket(keys).eqNullSafe(F.col("__bucket")), "left_semi").select(*keys, F.struct(*columns).alias(n)) for t, n in ((ours, "__ours"), (theirs, "__theirs")))
    both = left.join(right, keys, "full")
    held = F.col("__ours").isNotNull() & F.col("__theirs").isNotNull()
    same = lambda c: F.col(f"__ours.{c}").eqNullSafe(F.col(f"__theirs.{c}"))
    row = both.agg(*(x for c in columns for x in (F.count_if(held & same(c)).alias(f"{c}__equal"), F.count_if(held & ~same(c)).alias(f"{c}__different"), F.count_if(F.col("__theirs").isNull()).alias(f"{c}__only_ours"), F.count_if(F.col("__ours").isNull()).alias(f"{c}__only_theirs"))))
    whole = row.crossJoin(F.broadcast(agreed)).withColumns({f"{c}__equal": F.col(f"{c}__equal") + F.col("__agreed") for c in columns})
    return unpivot(whole, columns, ["equal", "different", "only_ours", "only_theirs"])
