"""Queries over the feature catalogues. Each returns its features for every tick of the book view, rounded to four places.

The SQL for other engines is compiled from the same catalogue; tests/ compare the catalogue with pandas on its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.functions import windows as w
from bookflow.functions.exprs import clean, interval_report
from bookflow.operators import ewm, features_main, features_report, features_small, features_tabular, profile, rolling, samples, vector
from bookflow.operators.binned import matrix
from bookflow.plans.book import book, book_ctes
from bookflow.plans.staged import Catalogue
from bookflow.schema import ALPHA, HORIZONS, RAW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ["sym", "date", "session", "row_nr"]


def portable(sql: str) -> str:
    """Without the suffix of double literals, which only Spark has."""
    return re.sub(r"(?<=[0-9])D\b", "", sql)


def shown(x: str) -> str:
    """Four places. The small shift keeps decimal ties away, which engines round differently."""
    return f"round(CAST({x} AS DOUBLE) + 1.23456789e-7, 4)"


def placed(x: str) -> str:
    """:func:`shown` as Spark runs it: the nearest step of 1 / 10,000, without a decimal number for each value."""
    v = f"(CAST({x} AS DOUBLE) + 1.23456789e-7D)"
    return f"(rint({v} * 1e4D) / 1e4D + 0D)"


def wide(x: str) -> str:
    """For values of any size: the signed logarithm."""
    return f"(sign({x}) * ln(1 + abs({x})))"


def query(name: str, catalogue: Catalogue, outputs: list[str], long: bool = False, centred: bool = False, large: tuple[str, ...] = (), where: str | None = None) -> None:
    """Register a catalogue's outputs under a name."""
    part = catalogue.needed(outputs)
    columns = [*KEYS, *(f"{shown(wide(c) if c in large else c)} AS {c}" for c in outputs)]
    ours = [*KEYS, *(f"{placed(wide(c) if c in large else c)} AS {c}" for c in outputs)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = part.apply(book(spark, sf_dir, long, centred), [*KEYS, *outputs, *([] if where is None else re.findall(r"[a-z_][a-z_0-9]*", where))])
        return (rows.filter(where) if where else rows).selectExpr(*ours)

    ctes, last = part.ctes("book")
    QUERIES[name] = run
    ORACLE_SQL[name] = portable(f"WITH {', '.join([*book_ctes(long, centred), *ctes])} SELECT {', '.join(columns)} FROM {last}" + (f" WHERE {where}" if where else ""))


A = features_main.CATALOGUE
ODD = features_main.ODD

query("raw_columns", Catalogue(), RAW)
query("book_spread_mid", A, [f"{n}_{i}" for n in ("spread", "mid_price") for i in ODD])
query("book_density_weighted", A, ["relative_bid_density_1", "relative_ask_density_1", "relative_bid_density_3", "relative_ask_density_3", "weighted_ab_1", "weighted_ab_3"])
query("book_imbalance", A, [*(f"vol{k}_rel_diff" for k in ODD), "total_imbalance", "total_imbalance_weighted"])
query("amount_normalized", A, ["amount_normalized"])
query("log_sizes", A, [f"log_{s}{i}" for s in ("bsize", "asize") for i in ODD])
query("price_plus1", A, [f"{s}{i}_plus1" for s in ("bid", "ask") for i in ODD])
query("book_cross_weighted", A, ["cross_weighted_1", "cross_weighted_2"])
query("book_slopes", A, ["bid_slope", "ask_slope"])
query("book_depth_pressure", A, ["weighted_depth_imbalance", "depth_pressure", "orderbook_pressure"])
query("book_convexity", A, ["bid_convexity", "ask_convexity", "book_curvature"])
query("trade_intensity", A, ["buy_intensity", "sell_intensity"])
query("micro_price", A, ["micro_price", "micro_price_diff"])
query("time_features", A, ["time_seconds", "time_interval"])
query("time_features_report", Catalogue([[("time_interval", interval_report("tod"))]]), ["time_interval"])
query("tick_deltas", A, ["close_delta", "bid1_delta", "ask1_delta", "midprice_delta"])
query("rolling10_close_mid", A, ["close_mean", "close_std", "close_vs_mean", "midprice_mean", "midprice_std", "midprice_ma5", *(f"mid_price_{i}_{m}" for i in ODD for m in ("mean", "std"))])
query("rolling10_stats", A, [f"{s}{i}_{m}" for s in ("bid", "ask") for i in ODD for m in ("mean", "std", "vs_mean")])
query("rolling10_sizes", A, [f"{s}{i}_{m}" for s in ("bsize", "asize") for i in ODD for m in ("mean", "std", "vs_mean")])
query("volatility", A, [f"volatility_{p}" for p in features_main.VOLATILITY])
query("roc", A, [f"roc_{p}" for p in features_main.ROC])
query("roc_centred", A, [f"roc_{p}" for p in features_main.ROC], long=True, centred=True, large=tuple(f"roc_{p}" for p in features_main.ROC))
query("imbalance_means", A, ["vol1_rel_diff_mean_5", "vol1_rel_diff_mean_20"])
query("zscore", A, [f"{n}_zscore_{k}" for n in ("price", "amount") for k in features_main.LONG], long=True)
query("slope", A, [f"{n}_slope_{k}" for n in ("price", "amount") for k in features_main.LONG], long=True)
query("percentile_position", A, ["price_percentile_100"], long=True)
query("elasticity", A, ["price_elasticity_10"], large=("price_elasticity_10",))
query("lags", A, [*(f"lag_mid_{k}" for k in (1, 5, 20)), *(f"lag_{s}1_{k}" for s in ("bid", "ask", "bsize", "asize") for k in (1, 5))])
query("volume_flow", A, [f"volume_flow_{p}" for p in (5, 20, 60)], long=True)
query("vpin", A, ["vpin_5", "vpin_20"])
query("ofi", A, ["ofi_1", "ofi_avg_3", "ofi_1_rolling_5"])
query("ofi_spread_ratio", A, ["ofi_spread_ratio"], large=("ofi_spread_ratio",))
query("momentum_sync", A, ["ofi_momentum_sync"])
query("accel_velocity", A, ["midprice_accel", "energy_burst", "imb_velocity", "imb_accel"])
query("vov", A, ["vov_10"])
query("tabular_rows", features_tabular.CATALOGUE, [n for s in features_tabular.CATALOGUE.stages[:2] for n, _ in s])
query("tabular_mid_diffs", features_tabular.CATALOGUE, [f"mid_diff_{k}" for k in (1, 5, 10, 20)])
for rolled in features_tabular.ROLLED:
    query(f"tabular_rolling_{rolled}", features_tabular.CATALOGUE, [n for n in features_tabular.ROLLING if n.startswith(f"{rolled}_roll_")], long=True)
query("report_rows", features_report.catalogue(5), [n for n, _ in features_report.catalogue(5).stages[0]])
query("report_windows", features_report.catalogue(3), [n for n, _ in features_report.catalogue(3).stages[1]])
query("report_windows_deep", features_report.catalogue(5), [n for n, _ in features_report.catalogue(5).stages[1] if n not in features_report.catalogue(3).names()])
query("template_features", features_small.CATALOGUE, features_small.FEATURES, long=True)


def _ofi_by_sym(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.needed(["ofi_1"]).apply(book(spark, sf_dir))
    return rows.groupBy("sym").agg(F.count(F.lit(1)).alias("ticks"), F.round(F.sum("ofi_1"), 4).alias("ofi_sum"), F.round(F.avg("ofi_1"), 6).alias("ofi_mean"))


_CTES, _LAST = A.needed(["ofi_1"]).ctes("book")
QUERIES["ofi_by_sym"] = _ofi_by_sym
ORACLE_SQL["ofi_by_sym"] = portable(f"WITH {', '.join([*book_ctes(), *_CTES])} SELECT sym, count(*) AS ticks, round(sum(ofi_1), 4) AS ofi_sum, round(avg(ofi_1), 6) AS ofi_mean FROM {_LAST} GROUP BY sym")


# Recursive averages: a grouped map here, a fold over lists in SQL.
def _fold(x: str, alpha: float) -> str:
    values = f"list({x}) OVER ({w.OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"list_reduce({values}, lambda y, v: {1 - alpha!r} * y + {alpha!r} * v)"


def _recursive(name: str, outputs: list[str], stages: list[list[tuple[str, str]]], needs: list[str]) -> None:
    part = A.needed(needs) if needs else Catalogue()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ticks = part.apply(book(spark, sf_dir)).select(*KEYS, "n_midprice", *needs)
        return ewm.recursive_features(ticks, outputs).selectExpr(*KEYS, *(f"{shown(c)} AS {c}" for c in outputs))

    ctes, last = Catalogue([*part.stages, *stages]).ctes("book")
    QUERIES[name] = run
    ORACLE_SQL[name] = portable(f"WITH {', '.join([*book_ctes(), *ctes])} SELECT {', '.join([*KEYS, *(f'{shown(c)} AS {c}' for c in outputs)])} FROM {last}")


_recursive("macd", ["macd_dif", "macd_dea", "macd_bar"], [[("macd_dif", f"({_fold('n_midprice', ewm.alpha_of(12))} - {_fold('n_midprice', ewm.alpha_of(26))})")], [("macd_dea", _fold("macd_dif", ewm.alpha_of(9)))], [("macd_bar", "(macd_dif - macd_dea)")]], [])
_recursive("kdj", ["kdj_k", "kdj_d", "kdj_j"], [[("kdj_k", _fold("rsv", 1 / 3))], [("kdj_d", _fold("kdj_k", 1 / 3))], [("kdj_j", "(3 * kdj_k - 2 * kdj_d)")]], ["rsv"])
_recursive("ofi_ema", ["ofi_ema_5", "ofi_ema_10"], [[(f"ofi_ema_{k}", _fold("ofi_1", ewm.alpha_of(k))) for k in (5, 10)]], ["ofi_1"])


def _ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ewm.scan(book(spark, sf_dir).select(*KEYS, "n_midprice"), "n_midprice", {"ewm_5": ewm.alpha_of(5)}).selectExpr(*KEYS, f"{shown('ewm_5')} AS ewm_5")


QUERIES["ewm"] = _ewm
ORACLE_SQL["ewm"] = portable(f"WITH {', '.join(book_ctes())} SELECT {', '.join(KEYS)}, {shown(_fold('n_midprice', ewm.alpha_of(5)))} AS ewm_5 FROM book")


# Vectors: a checksum of each, so that hundreds of columns compare as a few.
def _pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.needed(["total_imbalance"]).apply(book(spark, sf_dir)).select(*KEYS, *RAW, "total_imbalance")
    rows = vector.pyramid(part, [*RAW, "total_imbalance"])
    total = lambda a, b: F.aggregate(F.slice("vector", a, b), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select(*KEYS, F.size("vector").alias("length"), F.round(total(4, 1), 3).alias("first_bid"), F.round(total(121, 12), 3).alias("summary"), F.round(F.element_at("vector", 99).cast("double"), 3).alias("t4_mid"))


_CTES, _LAST = A.needed(["total_imbalance"]).ctes("book")
_BACK = " + ".join(f"CAST({w.clamped(c, k)} AS FLOAT)::DOUBLE" for k in vector.SUMMARY for c in ("n_midprice", "total_imbalance"))
QUERIES["pyramid_vector"] = _pyramid
ORACLE_SQL["pyramid_vector"] = portable(
    f"WITH {', '.join([*book_ctes(), *_CTES])} SELECT {', '.join(KEYS)}, CAST(132 AS INT) AS length, round(CAST(n_bid1 AS FLOAT)::DOUBLE, 3) AS first_bid, round({_BACK}, 3) AS summary, round(CAST({w.clamped('n_midprice', 4)} AS FLOAT)::DOUBLE, 3) AS t4_mid FROM {_LAST}"
)


def _flatten(pad: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vector.flatten_window(book(spark, sf_dir).select(*KEYS, "n_midprice", "n_bsize1"), ["n_midprice", "n_bsize1"], 100, pad)
        total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
        return rows.select(*KEYS, F.size("vector").alias("length"), F.round(F.element_at("vector", 1).cast("double"), 4).alias("oldest_mid"), F.round(F.element_at("vector", 199).cast("double"), 4).alias("newest_mid"), F.round(total, 2).alias("total"))

    return run


def _flatten_sql(pad: str) -> str:
    missing = "greatest(100 - row_nr, 0)"
    oldest = f"CASE WHEN row_nr >= 100 THEN {w.lag('f_mid', 99)} ELSE {w.first('f_mid') if pad == 'first' else '0'} END"
    fill = f" + {missing} * ({w.first('f_mid')} + {w.first('f_size')})" if pad == "first" else ""
    return f"WITH {', '.join(book_ctes())}, f AS (SELECT *, CAST(n_midprice AS FLOAT)::DOUBLE AS f_mid, CAST(n_bsize1 AS FLOAT)::DOUBLE AS f_size FROM book) SELECT {', '.join(KEYS)}, CAST(200 AS INT) AS length, round({oldest}, 4) AS oldest_mid, round(f_mid, 4) AS newest_mid, round({w.rolling('sum', 'f_mid', 100)} + {w.rolling('sum', 'f_size', 100)}{fill}, 2) AS total FROM f"


for pad in ("first", "zero"):
    QUERIES[f"flatten_window_{pad}"] = _flatten(pad)
    ORACLE_SQL[f"flatten_window_{pad}"] = portable(_flatten_sql(pad))


# All features at once: a checksum of every column, and of every block of the whole vector.
def bounded(c: str) -> str:
    """A feature as a small number of four places, whatever its size."""
    return shown(wide(f"CAST({c} AS DOUBLE)"))


def summed(x: str) -> str:
    """Two places of a sum of such numbers; the shift keeps ties away."""
    return f"round(sum({x}) + 1.23456789e-5, 2)"


def _main_ctes() -> tuple[list[str], str]:
    """SQL of the 182 features, cleaned and cast as the vector holds them."""
    recursions = [
        [("macd_dif", f"({_fold('n_midprice', ewm.alpha_of(12))} - {_fold('n_midprice', ewm.alpha_of(26))})"), ("kdj_k", _fold("rsv", 1 / 3)), *((f"ofi_ema_{k}", _fold("ofi_1", ewm.alpha_of(k))) for k in (5, 10))],
        [("macd_dea", _fold("macd_dif", ewm.alpha_of(9))), ("kdj_d", _fold("kdj_k", 1 / 3))],
        [("macd_bar", "(macd_dif - macd_dea)"), ("kdj_j", "(3 * kdj_k - 2 * kdj_d)")],
    ]
    ctes, last = Catalogue([*A.stages, *recursions]).ctes("book")
    cleaned = ", ".join(f"CAST({clean(f'CAST({c} AS DOUBLE)')} AS FLOAT) AS {c}" for c in features_main.FEATURES)
    return [*book_ctes(), *ctes, f"cleaned AS (SELECT {', '.join(KEYS)}, {cleaned} FROM {last})"], "cleaned"


def _steps(x: np.ndarray, log: bool = True) -> np.ndarray:
    """:func:`bounded`, or without the logarithm :func:`shown`, as whole numbers of 1 / 10,000."""
    x = x.astype(float)
    return np.rint(((np.copysign(np.log(1 + np.abs(x)), x) if log else x) + 1.23456789e-7) * 1e4)


def _by_instrument(batch: pa.RecordBatch, sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows that come by instrument as a row for each of them: sums of whole numbers, and the rows."""
    runs = pc.run_end_encode(batch.column("sym"))
    starts = np.r_[0, runs.run_ends.to_numpy()[:-1]]
    added = [np.add.reduceat(v, starts).astype(np.int64) for v in (np.ones(batch.num_rows), *sums.values())]
    return pa.RecordBatch.from_arrays([runs.values, *(pa.array(v) for v in added)], names=["sym", "n", *sums])


def _checksums(n: str, sums: list[str]) -> list[Column]:
    return [F.sum("n").alias(n), *(F.expr(f"round(sum({c}) / 1e4D + 1.23456789e-5, 2) AS {c}") for c in sums)]


def _main_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 182 features: by instrument, the ticks and a checksum of each column."""
    names = features_main.FEATURES
    rows = features_main.features(book(spark, sf_dir, ranged=True).select(*KEYS, *RAW, "tod")).select("sym", *names)

    def sums(batches):
        for batch in batches:
            if batch.num_rows:
                now = matrix(batch.column("now"))
                yield _by_instrument(batch, {c: _steps(now[:, k]) for k, c in enumerate(names)})

    parts = vector.packed(rows, names).mapInArrow(sums, f"sym {rows.schema['sym'].dataType.simpleString()}, n long, {', '.join(f'{c} long' for c in names)}")
    return parts.groupBy("sym").agg(*_checksums("ticks", names))


_CTES, _LAST = _main_ctes()
QUERIES["main_features_182"] = _main_features
ORACLE_SQL["main_features_182"] = portable(f"WITH {', '.join(_CTES)} SELECT sym, count(*) AS ticks, {', '.join(f'{summed(bounded(c))} AS {c}' for c in features_main.FEATURES)} FROM {_LAST} GROUP BY sym")


def _pyramid_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of 922 values with the tick's move and label: by instrument, checksums of its five full frames and of the summary."""
    names, n = features_main.FEATURES, len(features_main.FEATURES)
    move = F.col("price_diff_20")
    label = F.when(move < -ALPHA[20], 0).when(move > ALPHA[20], 2).otherwise(1)
    targeted = samples.with_targets(book(spark, sf_dir, ranged=True)).select(*KEYS, *RAW, "tod", "price_diff_20", label.alias("label"))
    rows = features_main.features(targeted, placed=True).select("sym", "price_diff_20", "label", rolling.AT, *names)
    frames = [f"frame_{k}" for k in vector.RECENT]

    def sums(ticks: pa.RecordBatch, vectors: np.ndarray) -> pa.RecordBatch:
        steps = _steps(vectors)
        own = {f: steps[:, n * k : n * (k + 1)].sum(axis=1) for k, f in enumerate(frames)} | {"summary": steps[:, n * len(frames) :].sum(axis=1)}
        own |= {"price_diff_20": _steps(ticks.column("price_diff_20").to_numpy(), False), "labels": ticks.column("label").to_numpy()}
        found = _by_instrument(ticks, own)
        return found.append_column("length", pa.array(np.full(found.num_rows, vectors.shape[1], np.int32)))

    kinds = ", ".join(f"{c} long" for c in ("n", *frames, "summary", "price_diff_20", "labels"))
    parts = vector.pyramid_stream(rows, names, sums, f"sym {rows.schema['sym'].dataType.simpleString()}, {kinds}, length int")
    count, *checks = _checksums("vectors", [*frames, "summary", "price_diff_20"])
    return parts.groupBy("sym").agg(count, F.max("length").alias("length"), F.sum("labels").alias("labels"), *checks)


_ROW = " + ".join(bounded(c) for c in features_main.FEATURES)
_SUMMARY = " + ".join(bounded(w.clamped(c, k)) for k in vector.SUMMARY for c in ("n_midprice", "total_imbalance"))
_MOVE = f"(coalesce({w.lead('n_midprice', 20)} - n_midprice, 0))"
_FRAMES = ", ".join(f"{summed(f'frame_{k}')} AS frame_{k}" for k in vector.RECENT)
QUERIES["pyramid_vector_922"] = _pyramid_whole
ORACLE_SQL["pyramid_vector_922"] = portable(
    f"WITH {', '.join(_CTES)}, m AS (SELECT {', '.join(KEYS)}, {_MOVE} AS move FROM book), r AS (SELECT *, {_ROW} AS row_sum FROM {_LAST} JOIN m USING ({', '.join(KEYS)})), "
    f"v AS (SELECT sym, CASE WHEN move < -{ALPHA[20]!r} THEN 0 WHEN move > {ALPHA[20]!r} THEN 2 ELSE 1 END AS label, {shown('move')} AS price_diff_20, {', '.join(f'{w.clamped('row_sum', k) if k else 'row_sum'} AS frame_{k}' for k in vector.RECENT)}, {_SUMMARY} AS summary FROM r) "
    f"SELECT sym, count(*) AS vectors, CAST(922 AS INT) AS length, CAST(sum(label) AS BIGINT) AS labels, {_FRAMES}, {summed('summary')} AS summary, {summed('price_diff_20')} AS price_diff_20 FROM v GROUP BY sym"
)


def _targets() -> tuple[Callable, str]:
    columns = [*KEYS, *(f"{shown(f'price_diff_{h}')} AS price_diff_{h}" for h in HORIZONS)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return samples.emit(samples.with_targets(book(spark, sf_dir))).selectExpr(*columns)

    exprs = ", ".join(f"coalesce({w.lead('n_midprice', h)} - n_midprice, 0) AS price_diff_{h}" for h in HORIZONS)
    keep = "local_idx >= 4 AND NOT (n_ask1 = 0 OR n_bid1 = 0 OR n_close >= 0.095 OR n_close <= -0.095)"
    return run, f"WITH {', '.join(book_ctes())}, t AS (SELECT *, {exprs}, row_nr - 1 AS local_idx FROM book) SELECT {', '.join(columns)} FROM t WHERE {keep}"


QUERIES["sample_emission"], _SQL = _targets()
ORACLE_SQL["sample_emission"] = portable(_SQL)


def _count_query(name: str, build: Callable[[DataFrame], DataFrame], sql: str, long: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(book(spark, sf_dir, long))
    ORACLE_SQL[name] = portable(f"WITH {', '.join(book_ctes(long))} {sql}")


LIMITED = "(n_ask1 = 0 OR n_bid1 = 0 OR n_close >= 0.095 OR n_close <= -0.095)"
_count_query("limit_filter", lambda t: samples.emit(samples.with_targets(t), 0).groupBy("sym").agg(F.count(F.lit(1)).alias("ticks")), f"SELECT sym, count(*) AS ticks FROM book WHERE NOT {LIMITED} GROUP BY sym")
_count_query("min_history", lambda t: samples.emit(samples.with_targets(t), 4, True).groupBy("sym", "date", "session").agg(F.count(F.lit(1)).alias("ticks")), "SELECT sym, date, session, count(*) AS ticks FROM book WHERE row_nr > 4 GROUP BY ALL")
_count_query("split_date", lambda t: samples.split_by_date(t, 1996).groupBy("split").agg(F.count(F.lit(1)).alias("ticks")), "SELECT CASE WHEN date < 1996 THEN 'train' ELSE 'val' END AS split, count(*) AS ticks FROM book GROUP BY 1")
_count_query(
    "split_index",
    lambda t: samples.split_by_index(t).groupBy("split").agg(F.count(F.lit(1)).alias("ticks"), F.countDistinct("sym", "date", "session").alias("files")),
    ", f AS (SELECT date, session, sym, count(*) AS n FROM book GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY date, session, sym) AS nr, count(*) OVER () AS files FROM f) SELECT CASE WHEN nr <= floor(files * 0.8) THEN 'train' ELSE 'val' END AS split, CAST(sum(n) AS BIGINT) AS ticks, count(*) AS files FROM r GROUP BY 1",
)
_count_query(
    "drop_rolling_null",
    lambda t: features_tabular.complete_rows(t.selectExpr("*", f"{w.rolling_full('avg', 'n_midprice', 100)} AS m100", f"{w.rolling_full('avg', 'n_midprice', 20)} AS m20"), ["m100", "m20"]).groupBy("sym", "date", "session").agg(F.count(F.lit(1)).alias("ticks")),
    ", r AS (SELECT *, row_number() OVER (PARTITION BY sym, date, session ORDER BY row_nr DESC) AS rows_left FROM book) SELECT sym, date, session, count(*) AS ticks FROM r WHERE row_nr >= 100 OR rows_left <= 60 GROUP BY ALL",
)
_count_query("endpoint_sample", lambda t: samples.endpoints(t, 100, 60, 7, 20).groupBy("sym").agg(F.count(F.lit(1)).alias("windows"), F.sum("idx").alias("idx_sum")), ", r AS (SELECT *, row_nr - 1 AS idx, count(*) OVER (PARTITION BY sym, date, session) AS n FROM book) SELECT sym, count(*) AS windows, CAST(sum(idx) AS BIGINT) AS idx_sum FROM r WHERE idx >= 99 AND idx < n - 60 AND (idx - 99) % 7 = 0 AND (idx - 99) / 7 < 20 GROUP BY sym", long=True)
_count_query("last_ticks", lambda t: vector.last_rows(t).selectExpr(*KEYS, f"{shown('n_midprice')} AS n_midprice"), f"SELECT {', '.join(KEYS)}, {shown('n_midprice')} AS n_midprice FROM (SELECT *, row_number() OVER (PARTITION BY sym, date, session ORDER BY row_nr DESC) AS e FROM book) WHERE e = 1")

_LABEL = {h: f"CASE WHEN {w.lead('n_midprice', h)} - n_midprice < -{ALPHA[h]!r} THEN 0 WHEN {w.lead('n_midprice', h)} - n_midprice > {ALPHA[h]!r} THEN 2 WHEN {w.lead('n_midprice', h)} IS NOT NULL THEN 1 END" for h in HORIZONS}
_PAST = {h: f"CASE WHEN n_midprice - {w.lag('n_midprice', h)} < -{ALPHA[h]!r} THEN 0 WHEN n_midprice - {w.lag('n_midprice', h)} > {ALPHA[h]!r} THEN 2 WHEN {w.lag('n_midprice', h)} IS NOT NULL THEN 1 END" for h in HORIZONS}
_LABELLED = "l AS (SELECT *, " + ", ".join(f"{_LABEL[h]} AS label_{h}, {_PAST[h]} AS past_{h}" for h in HORIZONS) + " FROM book)"
_count_query("labels_from_mid", lambda t: profile.with_labels(t).select(*KEYS, *(f"label_{h}" for h in HORIZONS)), f", {_LABELLED} SELECT {', '.join(KEYS)}, {', '.join(f'label_{h}' for h in HORIZONS)} FROM l")
_count_query(
    "label_direction_check",
    lambda t: profile.label_direction(profile.with_labels(t)).select("horizon", "future_match", "future_total", "past_match", "past_total", F.round("future_ratio", 3).alias("future_ratio"), F.round("past_ratio", 3).alias("past_ratio"), "better"),
    f", {_LABELLED} "
    + " UNION ALL ".join(
        f"SELECT '{h}' AS horizon, count(label_{h}) AS future_match, count(label_{h}) AS future_total, count(*) FILTER (WHERE label_{h} = past_{h}) AS past_match, count(*) FILTER (WHERE label_{h} IS NOT NULL AND past_{h} IS NOT NULL) AS past_total, CAST(1.0 AS DOUBLE) AS future_ratio, round(count(*) FILTER (WHERE label_{h} = past_{h})::DOUBLE / count(*) FILTER (WHERE label_{h} IS NOT NULL AND past_{h} IS NOT NULL), 3) AS past_ratio, 'future' AS better FROM l"
        for h in HORIZONS
    ),
    long=True,
)
_count_query(
    "label_direction_files",
    lambda t: profile.label_direction(profile.with_labels(t), by=("sym", "date", "session")).select("sym", "date", "session", "horizon", "future_match", "future_total", "past_match", "past_total", F.round("past_ratio", 3).alias("past_ratio")),
    f", {_LABELLED}, c AS ("
    + " UNION ALL ".join(
        f"SELECT sym, date, session, '{h}' AS horizon, count(label_{h}) AS future_match, count(label_{h}) AS future_total, count(*) FILTER (WHERE label_{h} = past_{h}) AS past_match, count(*) FILTER (WHERE label_{h} IS NOT NULL AND past_{h} IS NOT NULL) AS past_total FROM l GROUP BY sym, date, session"
        for h in HORIZONS
    )
    + ") SELECT *, round(round_even(past_match::DOUBLE / nullif(past_total, 0), 4), 3) AS past_ratio FROM c",
)
ALONE = [*KEYS, "window_end", f"{shown(w.rolling('avg', 'n_midprice', 60))} AS mean_60", f"{shown(w.clamped('n_midprice', 20))} AS mid_20", f"{shown(w.lag('n_bsize1', 5))} AS bid_size_5"]
_count_query(
    "lone_windows",
    lambda t: samples.lone_windows(t, 100).selectExpr(*ALONE),
    ", g AS (SELECT *, row_nr - 1 AS idx, count(*) OVER (PARTITION BY sym, date, session) AS n FROM book), p AS (SELECT *, CAST(floor(idx / 100) * 100 + 99 AS BIGINT) AS window_end FROM g), "
    f"a AS (SELECT * REPLACE (CAST(session AS BIGINT) * 1099511627776 + window_end AS session, CAST(idx % 100 + 1 AS INT) AS row_nr) FROM p WHERE window_end < n) SELECT {', '.join(ALONE)} FROM a",
    long=True,
)
