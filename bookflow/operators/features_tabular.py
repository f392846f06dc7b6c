"""The tabular feature set: 207 columns, missing values kept; rolling features need a full window."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bookflow.functions import windows as w
from bookflow.functions.exprs import flag, ln1p_clamped, mid_price, safe_div
from bookflow.plans.staged import Catalogue
from bookflow.schema import ASIZES, BSIZES, LEVELS, RAW

# What is added to divisors; window lengths; columns that are rolled; ticks at a session's end that stay
# whatever they lack.
EPS = 1e-8
SIZES = (5, 10, 20, 50, 100)
ROLLED = ("n_midprice", "spread_1", "imbalance_total", "bid_depth", "ask_depth", "log_amount_delta")
TAIL = 60


def _sum(columns: list[str]) -> str:
    return "(" + " + ".join(f"coalesce({c}, 0D)" for c in columns) + ")"


ROWS = (
    [("log_amount_delta", ln1p_clamped("amount_delta")), ("is_crossed_book", flag("n_bid1 > n_ask1")), ("calc_midprice", mid_price("n_bid1", "n_ask1"))]
    + [(f"spread_{i}", f"(n_ask{i} - n_bid{i})") for i in LEVELS]
    + [("spread_pct", safe_div("n_ask1 - n_bid1", "abs(n_midprice)", EPS)), ("bid_depth", _sum(BSIZES)), ("ask_depth", _sum(ASIZES))]
    + [(f"imbalance_{i}", safe_div(f"n_bsize{i} - n_asize{i}", f"n_bsize{i} + n_asize{i}", EPS)) for i in LEVELS]
    + [("weighted_midprice_1", safe_div("n_ask1*n_bsize1 + n_bid1*n_asize1", "n_bsize1 + n_asize1", EPS))]
)
DEPTH = [
    ("midprice_diff", "(n_midprice - calc_midprice)"),
    ("abs_midprice_diff", "abs(n_midprice - calc_midprice)"),
    ("is_midprice_mismatch", flag("abs(n_midprice - calc_midprice) > 1e-8")),
    ("total_depth", "(bid_depth + ask_depth)"),
    ("depth_diff", "(bid_depth - ask_depth)"),
    ("imbalance_total", safe_div("bid_depth - ask_depth", "bid_depth + ask_depth", EPS)),
]
FUNCTIONS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
WINDOWS = (
    [(f"mid_diff_{k}", w.diff("n_midprice", k)) for k in (1, 5, 10, 20)]
    + [(f"{x}_roll_{k}_{name}", w.rolling_full(f, x, k)) for x in ROLLED for k in SIZES for name, f in FUNCTIONS.items()]
    + [(f"{x}_roll_{k}_change", w.diff(x, k - 1)) for x in ROLLED for k in SIZES]
    + [(f"log_amount_delta_roll_{k}_sum", w.rolling_full("sum", "log_amount_delta", k)) for k in SIZES]
)
CATALOGUE = Catalogue([ROWS, DEPTH, WINDOWS])
FEATURES = ["sym_id", "session", *sorted([*RAW, *CATALOGUE.names()])]
ROLLING = [n for n in CATALOGUE.names() if "_roll_" in n]


def features(ticks: DataFrame) -> DataFrame:
    keys = [c for c in ticks.columns if c not in (*RAW, "session", "sym_id")]
    return CATALOGUE.apply(ticks).selectExpr(*keys, "sym AS sym_id", *(f"{c}" for c in FEATURES if c != "sym_id"))


def complete_rows(featured: DataFrame, columns: list[str] | None = None, tail: int = TAIL) -> DataFrame:
    """Without the rows that lack a rolling feature, except each session's last ``tail`` ticks."""
    lacking = " OR ".join(f"{c} IS NULL" for c in (columns or ROLLING))
    left = f"row_number() OVER (PARTITION BY {', '.join(('sym', 'date', 'session'))} ORDER BY row_nr DESC)"
    return featured.selectExpr("*", f"{left} AS rows_left").filter(f"NOT ({lacking}) OR rows_left <= {tail}").drop("rows_left")
