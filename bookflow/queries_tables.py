"""Queries of profiles, evaluation, candles and samples over the driver's tables, each with SQL of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.operators import candles, evaluate, profile, samples, signals
from bookflow.plans.book import SCORE_CTES, book, book_ctes, scores
from bookflow.queries_features import portable, shown
from bookflow.schema import HORIZONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_table(name: str, source: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(table(spark, sf_dir, source))
    ORACLE_SQL[name] = sql


def over_book(name: str, build: Callable[[DataFrame], DataFrame], sql: str, long: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(book(spark, sf_dir, long))
    ORACLE_SQL[name] = portable(f"WITH {', '.join(book_ctes(long))} {sql}")


def over_scores(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(scores(spark, sf_dir))
    ORACLE_SQL[name] = f"WITH {', '.join(SCORE_CTES)} {sql}"


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """Rounded after a small shift that keeps ties away."""
    return df.withColumns({c: F.round(F.col(c) + 1.23456789e-9, n) for c, n in places.items()})


def r(x: str, places: int) -> str:
    return f"round(CAST({x} AS DOUBLE) + 1.23456789e-9, {places})"


# Profiles.
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
over_table("profile_nulls", "lineitem", lambda d: profile.null_profile(d, NUMBERS), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, CAST(0 AS DOUBLE) AS null_ratio FROM lineitem" for c in NUMBERS))
over_table("missing_columns", "lineitem", lambda d: profile.missing_columns(d.withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.0))), NUMBERS).withColumn("null_ratio", F.round("null_ratio", 3)), "SELECT 'l_tax' AS \"column\", count(*) FILTER (WHERE l_tax = 0) AS nulls, round(count(*) FILTER (WHERE l_tax = 0)::DOUBLE / count(*), 3) AS null_ratio FROM lineitem")
over_table("duplicates", "lineitem", lambda d: profile.duplicate_rows(d, ["l_orderkey", "l_linenumber"]), "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicates FROM lineitem")
over_table("inf_counts", "lineitem", lambda d: profile.infinite_counts(d, NUMBERS), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE isinf({c})) AS infinite FROM lineitem" for c in NUMBERS))
over_table("value_counts", "lineitem", lambda d: rounded(profile.value_counts(d, "l_returnflag"), {"share": 6}), f"SELECT l_returnflag, count(*) AS n, {r('count(*)::DOUBLE / (SELECT count(*) FROM lineitem)', 6)} AS share FROM lineitem GROUP BY 1")
over_table("sorted_value_counts", "events", lambda d: d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type"), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
over_table("group_counts", "lineitem", lambda d: profile.group_counts(d, "l_returnflag", "l_linestatus", "l_linenumber"), "SELECT 'l_returnflag' AS dimension, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2")
over_table("label_pivot", "lineitem", lambda d: profile.pivot_counts(d, "l_linenumber", "l_returnflag", ["A", "N", "R"]), "SELECT l_linenumber, " + ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{v}') AS \"n_{v}\"" for v in "ANR") + " FROM lineitem GROUP BY 1")
over_table(
    "outliers_z5",
    "orders",
    lambda d: profile.outliers(d, ["o_totalprice"], 1.5),
    "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders) SELECT 'o_totalprice' AS \"column\", count(*) FILTER (WHERE abs(o_totalprice - m) > 1.5 * d) AS outliers, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders, s",
)
over_book("spread_stats", lambda t: rounded(profile.describe_column(t.selectExpr("n_ask1 - n_bid1 AS spread"), "spread"), {c: 5 for c in ("mean", "median", "std", "low", "high")}), f"SELECT count(*) AS n, {r('avg(n_ask1 - n_bid1)', 5)} AS mean, {r('quantile_cont(n_ask1 - n_bid1, 0.5)', 5)} AS median, {r('stddev_samp(n_ask1 - n_bid1)', 5)} AS std, {r('min(n_ask1 - n_bid1)', 5)} AS low, {r('max(n_ask1 - n_bid1)', 5)} AS high FROM book")
over_table("histogram80", "orders", lambda d: profile.histogram(d, "o_totalprice"), "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 80), 79) AS INT) AS bin, count(*) AS n FROM orders, e GROUP BY 1")
over_table("percentile_clip", "orders", lambda d: profile.clipped(d, "o_totalprice").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")), "WITH c AS (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b FROM orders) SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders, c WHERE o_totalprice BETWEEN a AND b")
_PAIRS = [(a, b) for k, a in enumerate(NUMBERS) for b in NUMBERS[k + 1 :]]
over_table("corr_matrix", "lineitem", lambda d: rounded(profile.correlations(d, NUMBERS), {"corr": 5}), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 5)} AS corr FROM lineitem" for a, b in _PAIRS))
over_book("monotonic_time", lambda t: profile.monotonic_time(t), ", b AS (SELECT *, lag(tod) OVER (PARTITION BY sym, date, session ORDER BY row_nr) AS before FROM book) SELECT sym, date, session, bool_and(coalesce(tod >= before, true)) AS monotonic, count(*) AS ticks FROM b GROUP BY 1, 2, 3")
over_book("crossed_book", lambda t: rounded(profile.crossed_book(t.selectExpr("* EXCEPT (n_ask1)", "n_ask1 - 0.01 AS n_ask1")), {"crossed_ratio": 2}), " UNION ALL ".join(f"SELECT '{i}' AS level, count(*) FILTER (WHERE n_bid{i} > n_ask{i}{' - 0.01' if i == 1 else ''}) AS crossed, {r(f'''round(count(*) FILTER (WHERE n_bid{i} > n_ask{i}{' - 0.01' if i == 1 else ''})::DOUBLE / count(*), 4)''', 2)} AS crossed_ratio FROM book" for i in range(1, 6)))
over_book("level_inversion", lambda t: profile.level_inversion(t.selectExpr("* EXCEPT (n_bid3)", "n_bid3 + n_bsize1 / 100000 AS n_bid3")), ", c AS (SELECT * REPLACE (n_bid3 + n_bsize1 / 100000 AS n_bid3) FROM book) " + " UNION ALL ".join(f"SELECT '{i}' AS level, count(*) FILTER (WHERE n_bid{i} > n_bid{i - 1}) AS bid_inverted, count(*) FILTER (WHERE n_ask{i} < n_ask{i - 1}) AS ask_inverted FROM c" for i in range(2, 6)))
over_table("negative_sizes", "customer", lambda d: rounded(profile.negative_sizes(d, ["c_acctbal"]), {"negative_ratio": 3}), f"SELECT 'c_acctbal' AS \"column\", count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(c_acctbal) AS known, {r('round(count(*) FILTER (WHERE c_acctbal < 0)::DOUBLE / count(c_acctbal), 4)', 3)} AS negative_ratio FROM customer")
over_book("midprice_rule", lambda t: rounded(profile.midprice_summary(t.selectExpr("* EXCEPT (n_midprice)", "n_midprice + CASE WHEN row_nr % 7 = 0 THEN 0.001 ELSE 0 END AS n_midprice")), {"mismatch_ratio": 3, "max_diff": 6, "mean_diff": 6}), f"SELECT count(*) AS checked, count(*) FILTER (WHERE row_nr % 7 = 0) AS mismatches, {r('round(count(*) FILTER (WHERE row_nr % 7 = 0)::DOUBLE / count(*), 4)', 3)} AS mismatch_ratio, {r('0.001', 6)} AS max_diff, {r('0.001 * count(*) FILTER (WHERE row_nr % 7 = 0) / count(*)', 6)} AS mean_diff FROM book")


def _completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected combinations of status, priority and year without any order."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderstatus", "o_orderpriority", "CAST(year(o_orderdate) AS INT) AS year")
    expected = orders.select("o_orderstatus").distinct().crossJoin(orders.select("o_orderpriority").distinct()).crossJoin(spark.range(1992, 2000).selectExpr("CAST(id AS INT) AS year"))
    return profile.missing_combinations(orders, expected, ["o_orderstatus", "o_orderpriority", "year"])


QUERIES["file_completeness"] = _completeness
ORACLE_SQL["file_completeness"] = "WITH o AS (SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INT) AS year FROM orders) SELECT * FROM (SELECT DISTINCT o_orderstatus FROM o), (SELECT DISTINCT o_orderpriority FROM o), (SELECT CAST(range AS INT) AS year FROM range(1992, 2000)) EXCEPT SELECT o_orderstatus, o_orderpriority, year FROM o"


def _file_rows(t: DataFrame) -> DataFrame:
    named = t.withColumn("source_file", F.format_string("snapshot_sym%d_date%d.csv", "sym", "date"))
    return profile.file_rows(named, named.filter("row_nr > 20"))


over_book("file_row_counts", _file_rows, "SELECT format('snapshot_sym{}_date{}.csv', sym, date) AS source_file, count(*) AS raw_rows, count(*) FILTER (WHERE row_nr > 20) AS kept_rows, count(*) FILTER (WHERE row_nr <= 20) AS dropped_rows, CASE WHEN count(*) FILTER (WHERE row_nr > 20) = 0 THEN 'empty' ELSE 'ok' END AS status FROM book GROUP BY sym, date")
over_table("feature_quality", "lineitem", lambda d: profile.feature_quality(d, NUMBERS), "SELECT count(*) * 4 - count(l_quantity) - count(l_extendedprice) - count(l_discount) - count(l_tax) AS missing, count(*) FILTER (WHERE isinf(l_tax)) AS infinite, CAST(0 AS INT) AS leaks FROM lineitem")
over_book("unique_groups", lambda t: t.select("sym", "date").distinct().groupBy("date").agg(F.count(F.lit(1)).alias("syms")), "SELECT date, count(DISTINCT sym) AS syms FROM book GROUP BY date")
over_table("union_tables", "customer", lambda d: d.selectExpr("c_custkey AS k", "c_acctbal").unionByName(d.selectExpr("c_custkey AS k", "c_mktsegment"), allowMissingColumns=True).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("balances")), "SELECT c_mktsegment, count(*) AS n, CAST(0 AS BIGINT) AS balances FROM customer GROUP BY 1 UNION ALL SELECT NULL, count(*), count(c_acctbal) FROM customer")

# Scores and signals.
ARGMAX = "CASE WHEN down >= flat AND down >= up THEN 0 WHEN flat >= up THEN 1 ELSE 2 END"
RULE = "CASE WHEN t <= 0 THEN ({argmax}) WHEN up > t AND (NOT down > t OR up >= down) THEN 2 WHEN down > t THEN 0 ELSE 1 END".format(argmax=ARGMAX)
GRID = f"(SELECT unnest([{', '.join(map(repr, signals.THRESHOLDS))}])::DOUBLE AS t)"


def measures_sql(keys: str, source: str, floor: str = "greatest(count(*) FILTER (WHERE y_true IN (0, 2)), 1)") -> str:
    act = "signal IN (0, 2)"
    pnl = "sum(CASE WHEN signal = 2 THEN price_diff WHEN signal = 0 THEN -price_diff ELSE 0 END)"
    return f"SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE {act}) AS trades, count(*) FILTER (WHERE {act} AND signal = y_true) AS correct, {floor} AS moves_floor, count(*) FILTER (WHERE y_true IN (0, 2)) AS moves, {pnl} AS total_pnl FROM {source} GROUP BY {keys}"


def rates_sql(keys: str, inner: str) -> str:
    return (
        f"SELECT {keys}, n, trades, correct, moves, total_pnl, coalesce(trades::DOUBLE / nullif(n, 0), 0) AS signal_pct, coalesce(correct::DOUBLE / nullif(trades, 0), 0) AS precision, coalesce(correct::DOUBLE / nullif(moves_floor, 0), 0) AS recall, coalesce(total_pnl / nullif(trades, 0), 0) AS avg_pnl FROM ({inner})"
    )


F05 = "(1.25 * precision * recall / (0.25 * precision + recall + 1e-10))"
SCORE = f"({F05} * (avg_pnl - 0.0004) * abs(avg_pnl - 0.0004) * 10000)"
ROUNDS = {"signal_pct": 6, "precision": 6, "recall": 6, "f05": 6, "total_pnl": 5, "avg_pnl": 7, "official_score_est": 7}


def final_sql(keys: str, inner: str, where: str = "") -> str:
    return f"SELECT {keys}, n, trades, correct, moves, {r('signal_pct', 6)} AS signal_pct, {r('precision', 6)} AS precision, {r('recall', 6)} AS recall, {r(F05, 6)} AS f05, {r('total_pnl', 5)} AS total_pnl, {r('avg_pnl', 7)} AS avg_pnl, {r(SCORE, 7)} AS official_score_est FROM ({inner}) {where}"


SWEEP = rates_sql("threshold", measures_sql("threshold", f"(SELECT t AS threshold, y_true, price_diff, {RULE} AS signal FROM scores, {GRID} g)"))
over_scores("threshold_sweep", lambda s: rounded(evaluate.threshold_sweep(s), ROUNDS), final_sql("threshold", SWEEP))
over_scores("official_score", lambda s: rounded(evaluate.threshold_sweep(s).select("threshold", "official_score_est"), {"official_score_est": 7}), f"SELECT threshold, {r(SCORE, 7)} AS official_score_est FROM ({SWEEP})")
over_scores("select_threshold", lambda s: evaluate.best(evaluate.threshold_sweep(s).withColumn("official_score_est", F.round("official_score_est", 9)), "official_score_est", "threshold").select("threshold", "trades"), f"SELECT threshold, trades FROM ({SWEEP}) ORDER BY round({SCORE}, 9) + 0.0 DESC, threshold LIMIT 1")
RATIOS = evaluate.ratio_values()
RATIO_SQL = rates_sql("down_ratio, up_ratio", measures_sql("down_ratio, up_ratio", f"(SELECT a.v AS down_ratio, b.v AS up_ratio, y_true, price_diff, CASE WHEN down * a.v >= flat AND down * a.v >= up * b.v THEN 0 WHEN flat >= up * b.v THEN 1 ELSE 2 END AS signal FROM scores, (SELECT unnest({RATIOS})::DOUBLE AS v) a, (SELECT unnest({RATIOS})::DOUBLE AS v) b)"))
over_scores("ratio_grid", lambda s: rounded(evaluate.ratio_grid(s, RATIOS), ROUNDS), final_sql("down_ratio, up_ratio", RATIO_SQL))
over_scores("ratio_best", lambda s: evaluate.best(evaluate.ratio_grid(s, RATIOS).withColumn("f05", F.round("f05", 9)), "f05", "down_ratio", "up_ratio").select("down_ratio", "up_ratio", "trades"), f"SELECT down_ratio, up_ratio, trades FROM ({RATIO_SQL}) ORDER BY round({F05}, 9) DESC, down_ratio, up_ratio LIMIT 1")


def _ratio_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades of all 676 pairs, most first."""
    return evaluate.ratio_grid(scores(spark, sf_dir)).select("down_ratio", "up_ratio", "trades").orderBy(F.desc("trades"), "down_ratio", "up_ratio")


QUERIES["ratio_grid_full"] = _ratio_full
ORACLE_SQL["ratio_grid_full"] = f"WITH {', '.join(SCORE_CTES)}, v AS (SELECT round(0.5 + 0.02 * range, 6)::DOUBLE AS v FROM range(26)), p AS (SELECT a.v AS down_ratio, b.v AS up_ratio, count(*) FILTER (WHERE (down * a.v >= flat AND down * a.v >= up * b.v) OR NOT flat >= up * b.v) AS trades FROM scores, v a, v b GROUP BY 1, 2) SELECT * FROM p ORDER BY trades DESC, down_ratio, up_ratio"
over_scores("legacy_threshold_sweep", evaluate.legacy_scan, f"SELECT t AS threshold, count(*) FILTER (WHERE down > t) + count(*) FILTER (WHERE up > t) AS signals, count(*) FILTER (WHERE down > t AND y_true = 0) + count(*) FILTER (WHERE up > t AND y_true = 2) AS correct FROM scores, {GRID} g GROUP BY t")


def signalled(s: DataFrame, t: float = 0.5) -> DataFrame:
    """Scores with the standard rule's signal at a threshold, and what it earns."""
    rule = signals.threshold_rule(F.col("down"), F.col("flat"), F.col("up"), F.lit(t))
    return s.withColumn("signal", rule).withColumn("pnl", F.round(signals.pnl(F.col("signal"), F.col("price_diff")), 6))


PNL = "round(CASE WHEN signal = 2 THEN price_diff WHEN signal = 0 THEN -price_diff ELSE 0.0 END, 6)"
SIGNALLED = f"s0 AS (SELECT *, {RULE.replace(' t ', ' 0.5 ').replace('> t', '> 0.5')} AS signal FROM scores), s AS (SELECT *, {PNL} AS pnl FROM s0)"
over_scores("signal_rules", lambda s: s.select(F.sum(signals.argmax(F.col("down"), F.col("flat"), F.col("up"))).alias("argmax"), F.sum(signals.threshold_rule(F.col("down"), F.col("flat"), F.col("up"), F.lit(0.5))).alias("threshold"), F.sum(signals.up_first_rule(F.col("down"), F.col("up"), F.lit(0.5))).alias("up_first"), F.sum(signals.sell_first_rule(F.col("down"), F.col("up"), F.lit(0.5))).alias("sell_first")), f", {SIGNALLED} SELECT CAST(sum({ARGMAX}) AS BIGINT) AS argmax, CAST(sum(signal) AS BIGINT) AS threshold, CAST(sum(CASE WHEN up > 0.5 THEN 2 WHEN down > 0.5 THEN 0 ELSE 1 END) AS BIGINT) AS up_first, CAST(sum(CASE WHEN down > 0.5 THEN 0 WHEN up > 0.5 THEN 2 ELSE 1 END) AS BIGINT) AS sell_first FROM s")
over_scores("confusion3", lambda s: evaluate.confusion(signalled(s), "date"), f", {SIGNALLED}, c AS (SELECT * FROM (SELECT DISTINCT date FROM s), (SELECT CAST(range AS INT) AS y_true FROM range(3)) a, (SELECT CAST(range AS INT) AS signal FROM range(3)) b) SELECT date, y_true, signal, count(s.sym) AS n FROM c LEFT JOIN s USING (date, y_true, signal) GROUP BY 1, 2, 3")
_CELL = " , ".join(f"count(*) FILTER (WHERE y_true = {t} AND signal = {p})::DOUBLE AS c{t}{p}" for t in range(3) for p in range(3))
_PER = ", ".join(f"coalesce(c{k}{k} / nullif(c0{k} + c1{k} + c2{k}, 0), 0) AS p{k}, coalesce(c{k}{k} / nullif(c{k}0 + c{k}1 + c{k}2, 0), 0) AS r{k}, c{k}0 + c{k}1 + c{k}2 AS n{k}" for k in range(3))
_F1 = ", ".join(f"coalesce(2 * p{k} * r{k} / nullif(p{k} + r{k}, 0), 0) AS f{k}" for k in range(3))
_N = "(n0 + n1 + n2)"
_row = lambda name, p, rec, f, n: f"SELECT '{name}' AS name, {r(p, 6)} AS precision, {r(rec, 6)} AS recall, {r(f, 6)} AS f1, {n} AS support FROM b"
_ACC = f"(c00 + c11 + c22) / {_N}"
over_scores(
    "class_report",
    lambda s: rounded(evaluate.class_report(signalled(s)), {"precision": 6, "recall": 6, "f1": 6}),
    f", {SIGNALLED}, c AS (SELECT {_CELL} FROM s), a AS (SELECT *, {_PER} FROM c), b AS (SELECT *, {_F1} FROM a) "
    + " UNION ALL ".join([*(_row(str(k), f"p{k}", f"r{k}", f"f{k}", f"n{k}") for k in range(3)), _row("accuracy", _ACC, _ACC, _ACC, _N), _row("macro", "(p0+p1+p2)/3", "(r0+r1+r2)/3", "(f0+f1+f2)/3", _N), _row("weighted", f"(p0*n0+p1*n1+p2*n2)/{_N}", f"(r0*n0+r1*n1+r2*n2)/{_N}", f"(f0*n0+f1*n1+f2*n2)/{_N}", _N)]),
)
over_scores("direction_purity", lambda s: rounded(evaluate.direction_purity(signalled(s)), {"purity": 6}), f", {SIGNALLED} SELECT count(*) FILTER (WHERE signal IN (0, 2) AND y_true IN (0, 2)) AS directional, {r('count(*) FILTER (WHERE signal IN (0, 2) AND signal = y_true)::DOUBLE / nullif(count(*) FILTER (WHERE signal IN (0, 2) AND y_true IN (0, 2)), 0)', 6)} AS purity FROM s")


def _confusion_diff(s: DataFrame) -> DataFrame:
    ours, theirs = evaluate.confusion(signalled(s), "date"), evaluate.confusion(signalled(s, 0.7), "date")
    return rounded(evaluate.confusion_diff(ours, theirs, "date"), {"accuracy": 6, "reference_accuracy": 6})


_OTHER = RULE.replace(" t ", " 0.7 ").replace("> t", "> 0.7")
over_scores(
    "confusion_diff",
    _confusion_diff,
    f", {SIGNALLED}, o AS (SELECT *, {_OTHER} AS other FROM s), x AS (SELECT date, y_true, signal AS p, count(*) AS n, 0 AS m FROM o GROUP BY ALL UNION ALL SELECT date, y_true, other, 0, count(*) FROM o GROUP BY date, y_true, other), y AS (SELECT date, y_true, p, sum(n) AS n, sum(m) AS m FROM x GROUP BY ALL) SELECT date, {r('sum(n) FILTER (WHERE y_true = p)::DOUBLE / sum(n)', 6)} AS accuracy, {r('sum(m) FILTER (WHERE y_true = p)::DOUBLE / sum(m)', 6)} AS reference_accuracy, CAST(sum(n) - sum(m) AS BIGINT) AS sample_diff, CAST(sum(abs(n - m)) AS BIGINT) AS cell_diff FROM y GROUP BY date",
)
over_scores("pnl_stats", lambda s: rounded(evaluate.pnl_stats(signalled(s)), {c: 6 for c in ("low", "high", "mean", "median", "std")}), f", {SIGNALLED} SELECT count(pnl) AS n, {r('min(pnl)', 6)} AS low, {r('max(pnl)', 6)} AS high, {r('avg(pnl)', 6)} AS mean, {r('quantile_cont(pnl, 0.5)', 6)} AS median, {r('stddev_pop(pnl)', 6)} AS std FROM s")
over_scores(
    "top_pct_pnl",
    lambda s: rounded(evaluate.top_percent(signalled(s).filter("signal <> 1"), 5.0), {"mean": 6, "total": 4, "low": 6, "high": 6}),
    f", {SIGNALLED}, b AS (SELECT CAST(signal AS VARCHAR) AS side, pnl FROM s WHERE signal <> 1 UNION ALL SELECT 'all', pnl FROM s WHERE signal <> 1), k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY pnl DESC) AS rk, count(*) OVER (PARTITION BY side) AS n FROM b) SELECT side, count(*) AS trades, {r('avg(pnl)', 6)} AS mean, {r('sum(pnl)', 4)} AS total, {r('min(pnl)', 6)} AS low, {r('max(pnl)', 6)} AS high FROM k WHERE rk <= greatest(floor(n * 0.05), 1) GROUP BY side",
)
DRAW_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "price_diff"]
over_scores(
    "max_drawdown",
    lambda s: rounded(evaluate.drawdown(signalled(s).filter("signal <> 1").withColumn("stretch", F.col("date")), ["sym"], DRAW_ORDER), {"max_drawdown": 5}),
    f", {SIGNALLED}, e AS (SELECT sym, sum(pnl) OVER w AS equity, row_number() OVER w AS k FROM s WHERE signal <> 1 WINDOW w AS (PARTITION BY sym ORDER BY {', '.join(DRAW_ORDER)})), p AS (SELECT *, greatest(max(equity) OVER (PARTITION BY sym ORDER BY k), 0) AS peak FROM e) SELECT sym, {r('min(least(equity - peak, 0))', 5)} AS max_drawdown FROM p GROUP BY sym",
)
over_scores(
    "signal_summary",
    lambda s: rounded(evaluate.signal_summary(signalled(s), "horizon_nr"), {**ROUNDS, "win_rate": 6, "avg_win": 6, "avg_loss": 6}),
    f", {SIGNALLED}, m AS ({rates_sql('horizon_nr', measures_sql('horizon_nr', 's', 'count(*) FILTER (WHERE y_true IN (0, 2))'))}), w AS (SELECT horizon_nr, {r('count(*) FILTER (WHERE signal <> 1 AND pnl > 0)::DOUBLE / count(*) FILTER (WHERE signal <> 1)', 6)} AS win_rate, {r('avg(pnl) FILTER (WHERE signal <> 1 AND pnl > 0)', 6)} AS avg_win, {r('avg(pnl) FILTER (WHERE signal <> 1 AND pnl <= 0)', 6)} AS avg_loss FROM s GROUP BY 1) SELECT * FROM ({final_sql('horizon_nr', 'SELECT * FROM m')}) JOIN w USING (horizon_nr)",
)
over_scores("class_weights", lambda s: rounded(samples.class_weights(s.withColumn("label", F.expr("CASE WHEN y_true = 1 AND l_orderkey % 2 = 0 THEN 0 ELSE y_true END"))), {"weight": 6}), f", c AS (SELECT CASE WHEN y_true = 1 AND l_orderkey % 2 = 0 THEN 0 ELSE y_true END AS label, count(*) AS n FROM scores GROUP BY 1) SELECT CAST(label AS INT) AS label, n, {r('(SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n)', 6)} AS weight FROM c")
over_scores(
    "profit_weights",
    lambda s: rounded(samples.profit_weights(s.withColumn("label", F.col("y_true"))).groupBy("sym").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")), {"weight": 4}),
    f", c AS (SELECT y_true, (SELECT count(*) FROM scores)::DOUBLE / (3 * count(*)) AS cw FROM scores GROUP BY 1), m AS (SELECT avg(abs(price_diff)) AS mm FROM scores) SELECT sym, count(*) AS n, {r('sum(least(greatest(1.0 + 1.0 * abs(price_diff) / (mm + 1e-10), 0.5), 3.0) * cw)', 4)} AS weight FROM scores JOIN c USING (y_true), m GROUP BY sym",
)
over_scores("label_totals", lambda s: samples.label_totals(s.withColumn("label", F.col("y_true"))), "SELECT y_true AS label, count(*) AS n FROM scores GROUP BY 1")
over_scores("mean_abs_move", lambda s: rounded(samples.mean_move(s), {"mean_move": 8}), f"SELECT {r('avg(abs(price_diff))', 8)} AS mean_move FROM scores")


# Candles and signals over ticks.
def _signal_rows(t: DataFrame) -> DataFrame:
    rows = samples.endpoints(samples.with_targets(t).drop("local_idx"), 100, max(HORIZONS))
    horizon = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"price_diff_{h}").alias("price_diff")) for h in HORIZONS)))
    long = rows.select("sym", "row_nr", F.col("n_midprice").alias("entry_mid"), horizon.alias("h")).select("sym", "row_nr", "entry_mid", "h.*")
    pred = F.when(F.col("row_nr") % 3 == 0, 0).when(F.col("row_nr") % 3 == 1, 2).otherwise(1)
    out = long.withColumn("pred", pred).withColumn("pnl", signals.pnl(F.col("pred"), F.col("price_diff")))
    return out.selectExpr("sym", "row_nr", "horizon", "pred", f"{shown('entry_mid')} AS entry_mid", f"{shown('entry_mid + price_diff')} AS exit_mid", f"{shown('price_diff')} AS price_diff", f"{shown('pnl')} AS pnl")


over_book(
    "signal_rows",
    _signal_rows,
    ", e AS (SELECT *, row_nr - 1 AS idx, count(*) OVER (PARTITION BY sym) AS n, "
    + ", ".join(f"lead(n_midprice, {h}) OVER (PARTITION BY sym ORDER BY row_nr) - n_midprice AS d{h}" for h in HORIZONS)
    + " FROM book), k AS (SELECT *, CAST(CASE WHEN row_nr % 3 = 0 THEN 0 WHEN row_nr % 3 = 1 THEN 2 ELSE 1 END AS INT) AS pred FROM e WHERE idx >= 99 AND idx < n - 60), u AS ("
    + " UNION ALL ".join(f"SELECT sym, row_nr, CAST({h} AS INT) AS horizon, pred, n_midprice AS m, d{h} AS d FROM k" for h in HORIZONS)
    + f") SELECT sym, row_nr, horizon, pred, {shown('m')} AS entry_mid, {shown('m + d')} AS exit_mid, {shown('d')} AS price_diff, {shown('CASE WHEN pred = 2 THEN d WHEN pred = 0 THEN -d ELSE 0 END')} AS pnl FROM u",
    long=True,
)
CANDLE_SQL = "SELECT sym, date, session, CAST(floor(tod / {s}) AS BIGINT) AS bucket, arg_min(n_midprice, row_nr) AS open, max(n_midprice) AS high, min(n_midprice) AS low, arg_max(n_midprice, row_nr) AS close, sum(amount_delta) AS volume, CAST(min(row_nr) - 1 AS INT) AS row_start, CAST(max(row_nr) - 1 AS INT) AS row_end, count(*) AS ticks FROM book GROUP BY ALL"
_candle = "sym, date, session, bucket, row_start, row_end, ticks, " + ", ".join(f"{shown(c)} AS {c}" for c in ("open", "high", "low", "close")) + f", {r('volume', 2)} AS volume"
over_book("candles_30m", lambda t: candles.numbered(rounded(candles.candles(t, 1800), {"volume": 2})).selectExpr(*(c for c in ("sym", "date", "session", "bucket", "row_start", "row_end", "ticks", "volume", "candle_idx")), *(f"{shown(c)} AS {c}" for c in ("open", "high", "low", "close"))), f", c AS ({CANDLE_SQL.format(s=1800)}) SELECT {_candle}, CAST(row_number() OVER (PARTITION BY sym, date, session ORDER BY bucket) - 1 AS INT) AS candle_idx FROM c")
over_book("candles_by_rows", lambda t: candles.candles(t.withColumn("tod", F.lit(0)), 10).selectExpr("sym", "date", "session", "bucket", "row_start", "row_end", f"{shown('open')} AS open", f"{shown('close')} AS close"), f"SELECT sym, date, session, CAST(floor((row_nr - 1) / 10) AS BIGINT) AS bucket, CAST(min(row_nr) - 1 AS INT) AS row_start, CAST(max(row_nr) - 1 AS INT) AS row_end, {shown('arg_min(n_midprice, row_nr)')} AS open, {shown('arg_max(n_midprice, row_nr)')} AS close FROM book GROUP BY 1, 2, 3, 4")
over_book("candle_markers", lambda t: candles.thinned(t, 25).select("sym", "date", "session", "row_nr"), ", k AS (SELECT *, row_nr - 1 AS place, count(*) OVER (PARTITION BY sym, date, session) AS n FROM book) SELECT sym, date, session, row_nr FROM k WHERE place % greatest(CAST(ceil(n / 25) AS INT), 1) = 0 AND floor(place / greatest(CAST(ceil(n / 25) AS INT), 1)) < 25")
def _by_time(t: DataFrame) -> DataFrame:
    """Ticks numbered by their times, as the rows of candles are."""
    return t.selectExpr("* EXCEPT (row_nr)", "CAST(row_number() OVER (PARTITION BY sym, date, session ORDER BY tod, row_nr) AS INT) AS row_nr")


def _candle_of_row(t: DataFrame) -> DataFrame:
    rows = _by_time(t)
    return candles.of_rows(rows.select("sym", "date", "session", "row_nr", "tod"), candles.numbered(candles.candles(rows, 1800)))


over_book(
    "candle_of_row",
    _candle_of_row,
    ", t AS (SELECT sym, date, session, tod, CAST(row_number() OVER (PARTITION BY sym, date, session ORDER BY tod, row_nr) AS INT) AS row_nr FROM book), "
    "b AS (SELECT sym, date, session, CAST(floor(tod / 1800) AS BIGINT) AS bucket, min(row_nr) - 1 AS row_start, max(row_nr) - 1 AS row_end FROM t GROUP BY ALL), "
    "c AS (SELECT *, CAST(row_number() OVER (PARTITION BY sym, date, session ORDER BY bucket) - 1 AS INT) AS candle_idx FROM b) "
    "SELECT t.sym, t.date, t.session, t.row_nr, t.tod, c.candle_idx FROM t LEFT JOIN c ON t.sym = c.sym AND t.date = c.date AND t.session = c.session AND t.row_nr - 1 BETWEEN c.row_start AND c.row_end",
)
over_book("candle_of_row_approximate", lambda t: t.selectExpr("sym", "date", "session", "row_nr", f"{candles.approximate_candle(30)} AS marker_candle"), "SELECT sym, date, session, row_nr, CAST(floor((row_nr - 1) / 10) AS INT) AS marker_candle FROM book")
over_book(
    "candles_of_long_groups",
    lambda t: candles.long_enough(candles.candles(t, 7200), 5).select("sym", "date", "session", "bucket", "ticks"),
    f", c AS ({CANDLE_SQL.format(s=7200)}), k AS (SELECT *, count(*) OVER (PARTITION BY sym, date, session) AS held FROM c) SELECT sym, date, session, bucket, ticks FROM k WHERE held >= 5",
)
