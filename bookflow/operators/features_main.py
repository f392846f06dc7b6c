"""The main feature set: 182 columns a tick, in stages by what they depend on.

Stage 1 is local to a row, stage 2 looks back over raw or stage-1 columns, stages 3 and 4 over windows of windows. The
recursive averages (MACD, KDJ, smoothed order flow) are added between by :mod:`bookflow.operators.ewm`, as they have no
constant-size window form.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from bookflow.functions import windows as w
from bookflow.functions.exprs import div, finite, interval_main, ln1p, safe_div, total, weighted
from bookflow.plans.staged import Catalogue
from bookflow.schema import ASIZES, ASKS, BIDS, BSIZES, LEVELS, RAW

# Levels that have features of their own; weights of the levels' depth; look-back lengths in ticks.
ODD = (1, 3, 5)
DEPTH_WEIGHTS = [1.0, 0.8, 0.6, 0.4, 0.2]
VOLATILITY = (5, 10, 20, 40, 60)
ROC = (1, 5, 10, 30, 60, 100)
LONG = (20, 100, 300)
SIDES = {"bid": "n_bid", "ask": "n_ask", "bsize": "n_bsize", "asize": "n_asize"}


def rel_diff(levels: int) -> str:
    b, a = total(BSIZES[:levels]), total(ASIZES[:levels])
    return safe_div(f"{b} - {a}", f"{b} + {a}")


def stage_rows() -> list[tuple[str, str]]:
    bids, asks = total(BSIZES), total(ASIZES)
    out = [(f"spread_{i}", f"(n_ask{i} - n_bid{i})") for i in LEVELS]
    out += [(f"mid_price_{i}", f"((n_ask{i} + n_bid{i}) / 2)") for i in LEVELS]
    for i in LEVELS:
        out += [(f"relative_bid_density_{i}", safe_div(f"n_bsize{i}", f"n_bsize{i} + n_asize{i}")), (f"relative_ask_density_{i}", safe_div(f"n_asize{i}", f"n_bsize{i} + n_asize{i}"))]
        out += [(f"weighted_ab_{i}", safe_div(f"n_bid{i}*n_asize{i} + n_ask{i}*n_bsize{i}", f"n_bsize{i} + n_asize{i}"))]
    out += [(f"vol{k}_rel_diff", rel_diff(k)) for k in ODD]
    out += [("amount_normalized", ln1p(div("amount_delta", "1 + n_midprice")))]
    out += [(f"log_{s}{i}", ln1p(f"n_{s}{i}")) for s in ("bsize", "asize") for i in LEVELS]
    out += [(f"{s}{i}_plus1", f"(n_{s}{i} + 1)") for s in ("bid", "ask") for i in ODD]
    out += [("cross_weighted_1", safe_div("n_ask1*n_bsize2 + n_ask2*n_bsize1", "n_bsize1 + n_bsize2")), ("cross_weighted_2", safe_div("n_bid1*n_asize2 + n_bid2*n_asize1", "n_asize1 + n_asize2"))]
    out += [("touch", "(2 + n_ask1 + n_bid1)")]
    out += [("total_imbalance", safe_div(f"{bids} - {asks}", f"{bids} + {asks}"))]
    wb, wa = safe_div(weighted(BIDS, BSIZES), bids), safe_div(weighted(ASKS, ASIZES), asks)
    out += [("total_imbalance_weighted", safe_div(f"{wb} - {wa}", f"{wb} + {wa}"))]
    out += [("bid_slope", safe_div("n_bid1 - n_bid5", "n_bid1")), ("ask_slope", safe_div("n_ask5 - n_ask1", "n_ask1"))]
    out += [("orderbook_pressure", safe_div(f"({bids} - {asks})*(n_midprice - n_bid1)", "n_ask1 - n_bid1"))]
    out += [("micro_price", safe_div("n_bid1*n_asize1 + n_ask1*n_bsize1", "n_bsize1 + n_asize1"))]
    b, a = weighted(BSIZES, DEPTH_WEIGHTS), weighted(ASIZES, DEPTH_WEIGHTS)
    out += [("weighted_depth_imbalance", safe_div(f"{b} - {a}", f"{b} + {a}")), ("depth_pressure", f"({b} + {a})*" + safe_div(f"{b} - {a}", f"{b} + {a}"))]
    convex = {s: safe_div(f"n_{k}1 + n_{k}5 - 2*n_{k}3", f"n_{k}3") for s, k in (("bid", "bsize"), ("ask", "asize"))}
    out += [("bid_convexity", convex["bid"]), ("ask_convexity", convex["ask"]), ("book_curvature", f"(({convex['bid']} + {convex['ask']}) / 2)")]
    out += [("buy_intensity", safe_div("amount_delta", "n_asize1")), ("sell_intensity", safe_div("amount_delta", "n_bsize1"))]
    return out + [("time_seconds", "tod"), ("time_interval", interval_main("tod"))]


def flow(i: int) -> str:
    """Order-flow imbalance of a level: what the bid side gained less what the ask side gained."""
    b, bs, a, s = f"n_bid{i}", f"n_bsize{i}", f"n_ask{i}", f"n_asize{i}"
    bid = f"CASE WHEN {b} > {w.lag(b)} THEN {bs} WHEN {b} = {w.lag(b)} THEN {bs} - {w.lag(bs)} ELSE -{w.lag(bs)} END"
    ask = f"CASE WHEN {a} < {w.lag(a)} THEN {s} WHEN {a} = {w.lag(a)} THEN {s} - {w.lag(s)} ELSE -{w.lag(s)} END"
    return f"coalesce(({bid}) - ({ask}), 0D)"


def moments(name: str, x: str, k: int = 10, ratio: bool = True) -> list[tuple[str, str]]:
    out = [(f"{name}_mean", w.rolling("avg", x, k)), (f"{name}_std", w.rolling("stddev_samp", x, k))]
    return out + ([(f"{name}_vs_mean", safe_div(x, w.rolling("avg", x, k)))] if ratio else [])


def stage_windows() -> list[tuple[str, str]]:
    m, v = "n_midprice", "amount_delta"
    out = [("close_delta", w.diff("n_close")), ("bid1_delta", w.diff("n_bid1")), ("ask1_delta", w.diff("n_ask1")), ("midprice_delta", w.diff(m))]
    out += moments("close", "n_close")
    for side, column in SIDES.items():
        for i in ODD:
            out += moments(f"{side}{i}", f"{column}{i}")
    for i in ODD:
        out += moments(f"mid_price_{i}", f"mid_price_{i}", ratio=False)
    out += moments("midprice", m, ratio=False) + [("midprice_ma5", w.rolling("avg", m, 5))]
    out += [(f"volatility_{p}", f"coalesce({safe_div('touch', w.lag('touch', p))} - 1, 0D)") for p in VOLATILITY]
    out += [(f"roc_{p}", f"coalesce({div(m, w.lag(m, p))} - 1, 0D)") for p in ROC]
    out += [(f"vol1_rel_diff_mean_{k}", w.rolling("avg", "vol1_rel_diff", k)) for k in (5, 20)]
    for name, x in (("price", m), ("amount", v)):
        out += [(f"{name}_zscore_{k}", w.zscore(x, k)) for k in LONG] + [(f"{name}_slope_{k}", w.slope(x, k)) for k in LONG]
    out += [("price_percentile_100", safe_div(f"{m} - {w.rolling('min', m, 100)}", f"{w.rolling('max', m, 100)} - {w.rolling('min', m, 100)}"))]
    out += [("price_elasticity_10", safe_div(f"coalesce({w.diff(m, 10)}, 0D)", w.rolling("sum", v, 10)))]
    out += [(f"ofi_{i}", flow(i)) for i in (1, 2, 3)]
    out += [("imb_velocity", f"coalesce({w.diff('total_imbalance')}, 0D)")]
    out += [(f"lag_mid_{k}", f"coalesce({w.lag(m, k)}, 0D)") for k in (1, 5, 20)]
    out += [(f"lag_{s}1_{k}", f"coalesce({w.lag(f'n_{s}1', k)}, 0D)") for s in ("bid", "ask", "bsize", "asize") for k in (1, 5)]
    out += [(f"volume_flow_{p}", safe_div(w.rolling("sum", v, p), f"coalesce({w.rolling('avg', v, 100)}, 1e-10D)")) for p in (5, 20, 60)]
    out += [("micro_price_diff", f"coalesce({w.diff('micro_price')}, 0D)")]
    out += [(f"vpin_{p}", safe_div(f"coalesce({w.rolling('stddev_samp', f'abs({v})', p)}, 1e-10D)", f"coalesce({w.rolling('avg', f'abs({v})', p)}, 1e-10D)")) for p in (5, 20)]
    low, high = w.rolling("min", "n_bid1", 9), w.rolling("max", "n_ask1", 9)
    return out + [("rsv", "100 * " + safe_div(f"{m} - {low}", f"{high} - {low}"))]


def stage_nested() -> list[tuple[str, str]]:
    accel = f"coalesce({w.diff('midprice_delta')}, 0D)"
    return [
        ("ofi_avg_3", "((ofi_1 + ofi_2 + ofi_3) / 3)"),
        ("ofi_1_rolling_5", w.rolling("sum", "ofi_1", 5)),
        ("ofi_spread_ratio", safe_div("ofi_1", "spread_1")),
        ("midprice_accel", accel),
        ("energy_burst", f"(amount_delta * {accel})"),
        ("imb_accel", f"coalesce({w.diff('imb_velocity')}, 0D)"),
        ("ofi_momentum_sync", "(ofi_1 * midprice_delta)"),
        ("vov_10", f"coalesce({w.rolling('stddev_samp', 'volatility_10', 5)}, 0D)"),
    ]


CATALOGUE = Catalogue([stage_rows(), stage_windows(), stage_nested()])
RECURSIVE = ["macd_dif", "macd_dea", "macd_bar", "kdj_k", "kdj_d", "kdj_j", "ofi_ema_5", "ofi_ema_10"]

#: Names in the fixed order of the feature vector, built by rule.
FEATURES = (
    RAW
    + [f"spread_{i}" for i in ODD]
    + [f"mid_price_{i}" for i in ODD]
    + [f"relative_{s}_density_{i}" for i in (1, 3) for s in ("bid", "ask")]
    + [f"weighted_ab_{i}" for i in (1, 3)]
    + [f"vol{k}_rel_diff" for k in ODD]
    + ["amount_normalized"]
    + [f"log_{s}{i}" for i in ODD for s in ("bsize", "asize")]
    + ["close_delta", "bid1_delta", "ask1_delta", "midprice_delta", "close_mean", "close_std", "close_vs_mean"]
    + [f"{s}{i}_{m}" for s in SIDES for i in ODD for m in ("mean", "std", "vs_mean")]
    + ["midprice_mean", "midprice_std"]
    + [f"mid_price_{i}_{m}" for i in ODD for m in ("mean", "std")]
    + ["time_seconds", "time_interval"]
    + [f"{s}{i}_plus1" for s in ("bid", "ask") for i in ODD]
    + ["cross_weighted_1", "cross_weighted_2", "midprice_ma5"]
    + [f"volatility_{p}" for p in VOLATILITY]
    + RECURSIVE[:6]
    + [f"roc_{p}" for p in ROC]
    + [f"vol1_rel_diff_mean_{k}" for k in (5, 20)]
    + [f"price_{f}_{k}" for f in ("zscore", "slope") for k in LONG]
    + ["price_percentile_100"]
    + [f"amount_{f}_{k}" for f in ("zscore", "slope") for k in LONG]
    + [f"lag_mid_{k}" for k in (1, 5, 20)]
    + [f"lag_{s}1_{k}" for s in ("bid", "ask", "bsize", "asize") for k in (1, 5)]
    + [f"volume_flow_{p}" for p in (5, 20, 60)]
    + ["total_imbalance", "total_imbalance_weighted", "bid_slope", "ask_slope", "price_elasticity_10", "orderbook_pressure"]
    + ["ofi_1", "ofi_avg_3", "ofi_1_rolling_5", "ofi_spread_ratio", "midprice_accel", "imb_velocity", "imb_accel", "energy_burst"]
    + ["micro_price", "micro_price_diff", "weighted_depth_imbalance", "ofi_momentum_sync", "vov_10", "bid_convexity", "ask_convexity"]
    + ["buy_intensity", "sell_intensity", "ofi_ema_5", "ofi_ema_10", "vpin_5", "vpin_20", "book_curvature", "depth_pressure"]
)


def available(columns: list[str]) -> list[str]:
    """The features, in order, that can be made from these raw columns; ``n_midprice`` and ``total_imbalance`` must be among them."""
    lacking = set(RAW) - set(columns)
    needs = {name: set(re.findall(r"[a-z_][a-z_0-9]*", e)) for stage in CATALOGUE.stages for name, e in stage}
    needs |= {n: {seed} for names, seed in ((RECURSIVE[:3], "n_midprice"), (RECURSIVE[3:6], "rsv"), (RECURSIVE[6:], "ofi_1")) for n in names}

    def known(name: str) -> bool:
        return name not in lacking and all(known(n) for n in needs.get(name, ()) if n != name)

    found = [f for f in FEATURES if known(f)]
    if not {"n_midprice", "total_imbalance"} <= set(found):
        raise ValueError("n_midprice and total_imbalance must be available")
    return found


def features(ticks: DataFrame, placed: bool = False) -> DataFrame:
    """All 182 features, cleaned (what isn't a number is 0) and cast to float last. ``ticks`` keeps its key columns; ``placed``: each
    tick's place in its group as well, in the order of which the rows come (``rolling.AT``).

    Rows are dealt and sorted once, while they are narrow. What windows of windows and recursions start from has short frames and is
    made where the rows were sorted; then recursions and moving windows are two passes of one stream, and what is local to a row is added last.
    """
    from bookflow.operators import rolling
    from bookflow.operators.ewm import Recursion

    keys = [c for c in ticks.columns if c not in RAW]
    local, looking_back, nested = CATALOGUE.stages
    first = CATALOGUE.needed(["rsv", *(n for n, _ in nested)])
    seeds = rolling.ordered(first.apply(ticks))
    stage, calls = rolling.calls_of([x for x in looking_back if x[0] not in first.names()])
    arguments = set(re.findall(r"[a-z_][a-z_0-9]*", " ".join(e for _, e in looking_back)))
    early = [x for x in local if x[0] in arguments and x[0] not in first.names()]
    narrow = Catalogue([early]).apply(seeds)
    wide = rolling.streamed(narrow, Recursion(), rolling.Moving(narrow, calls))
    late = [x for x in local if x[0] not in arguments and x[0] not in first.names()]
    whole = wide.selectExpr(*seeds.columns, *(n for n, _ in early), *RECURSIVE, *(f"{e} AS {n}" for n, e in [*stage, *late]))
    return whole.selectExpr(*keys, *([rolling.AT] if placed else []), *(f"CAST({finite(f'CAST({c} AS DOUBLE)')} AS FLOAT) AS {c}" for c in FEATURES))
