"""The report feature set: 163 columns over five levels, or 111 over three, and its 100-tick window vector."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bookflow.functions import windows as w
from bookflow.functions.exprs import clean, interval_report, ln1p, safe_div
from bookflow.operators.features_main import ODD, moments, rel_diff
from bookflow.plans.staged import Catalogue
from bookflow.schema import RAW


def catalogue(levels: int = 5) -> Catalogue:
    rows = [("time_seconds", "tod"), ("time_interval", interval_report("tod"))]
    ticks = [("close_delta", w.diff("n_close")), *moments("close", "n_close")]
    for i in range(1, levels + 1):
        sizes = f"n_bsize{i} + n_asize{i}"
        rows += [(f"spread_{i}", f"(n_ask{i} - n_bid{i})"), (f"mid_price_{i}", f"((n_ask{i} + n_bid{i}) / 2)")]
        rows += [(f"relative_bid_density_{i}", safe_div(f"n_bsize{i}", sizes)), (f"relative_ask_density_{i}", safe_div(f"n_asize{i}", sizes))]
        rows += [(f"log_bsize{i}", ln1p(f"n_bsize{i}")), (f"log_asize{i}", ln1p(f"n_asize{i}")), (f"weighted_ab_{i}", safe_div(f"n_bid{i}*n_asize{i} + n_ask{i}*n_bsize{i}", sizes))]
        ticks += [(f"{s}{i}_delta", w.diff(f"n_{s}{i}")) for s in ("bid", "ask", "bsize", "asize")] + [(f"mid_price_{i}_delta", w.diff(f"mid_price_{i}"))]
        for s in ("bid", "ask", "bsize", "asize"):
            ticks += moments(f"{s}{i}", f"n_{s}{i}")
        ticks += moments(f"mid_price_{i}", f"mid_price_{i}", ratio=False)
    rows += [(f"vol{k}_rel_diff", rel_diff(k)) for k in ODD] + [("amount_log", ln1p("amount_delta"))]
    return Catalogue([rows, ticks])


def feature_names(levels: int = 5) -> list[str]:
    """In the order of the window vector."""
    each = range(1, levels + 1)
    return (
        ["time_seconds", "time_interval", *RAW]
        + [f"spread_{i}" for i in each]
        + [f"mid_price_{i}" for i in each]
        + [f"relative_{s}_density_{i}" for i in each for s in ("bid", "ask")]
        + [f"weighted_ab_{i}" for i in each]
        + [f"vol{k}_rel_diff" for k in ODD]
        + ["amount_log", "close_delta", "close_mean", "close_std", "close_vs_mean"]
        + [f"log_{s}{i}" for i in each for s in ("bsize", "asize")]
        + [f"{s}{i}_delta" for i in each for s in ("bid", "ask", "mid_price_", "bsize", "asize")]
        + [f"{s}{i}_{m}" for i in each for s in ("bid", "ask", "bsize", "asize", "mid_price_") for m in ("mean", "std", "vs_mean") if (s, m) != ("mid_price_", "vs_mean")]
    )


def features(ticks: DataFrame, levels: int = 5) -> DataFrame:
    keys = [c for c in ticks.columns if c not in RAW]
    return catalogue(levels).apply(ticks).selectExpr(*keys, *(f"{clean(f'CAST({c} AS DOUBLE)')} AS {c}" for c in feature_names(levels)))
