"""Scalar expressions as SQL text that Spark runs inside whole-stage codegen (and other engines understand).

Every function takes and returns SQL text. Division never throws under ANSI mode: a zero divisor gives NULL.
"""

from __future__ import annotations

from bookflow.schema import EPS


def div(a: str, b: str) -> str:
    """a / b, NULL where b is 0."""
    return f"(({a}) / nullif({b}, 0))"


def safe_div(a: str, b: str, eps: float = EPS) -> str:
    """a / (b + eps)."""
    return div(a, f"({b}) + {eps!r}D")


def ln1p(x: str) -> str:
    """ln(1 + x), NULL where that isn't a number."""
    return f"(CASE WHEN ({x}) > -1 THEN ln(1 + ({x})) END)"


def ln1p_clamped(x: str) -> str:
    """ln(1 + max(x, 0)), a missing x as 0."""
    return f"ln(1 + greatest(coalesce({x}, 0D), 0D))"


def clean(x: str) -> str:
    """Numbers; NULL, NaN and infinities become 0."""
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) OR abs({x}) = CAST('Infinity' AS DOUBLE) THEN 0D ELSE ({x}) END)"


def finite(x: str) -> str:
    """As :func:`clean` for doubles, with fewer mentions of ``x``: NaN and infinities aren't below infinity in Spark, nor is NULL."""
    return f"coalesce(CASE WHEN abs({x}) < CAST('Infinity' AS DOUBLE) THEN {x} END, 0D)"


def known(x: str) -> str:
    """Text to a number; what isn't one, and NaN, is NULL."""
    return f"(CASE WHEN isnan(try_cast({x} AS DOUBLE)) THEN NULL ELSE try_cast({x} AS DOUBLE) END)"


def flag(condition: str) -> str:
    """1 where the condition holds, else 0 (also where it is unknown)."""
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"


def total(columns: list[str]) -> str:
    """Sum from left to right."""
    return "(" + " + ".join(columns) + ")"


def weighted(columns: list[str], weights: list[str | float]) -> str:
    return "(" + " + ".join(f"{w}*{c}" for c, w in zip(columns, weights)) + ")"


def clip(x: str, low: str | float, high: str | float) -> str:
    return f"least(greatest({x}, {low}), {high})"


def seconds(time: str) -> str:
    """HH:MM:SS to seconds of the day; anything else is 0."""
    part = lambda k: f"try_cast(split({time}, ':')[{k}] AS DOUBLE)"
    return f"(CASE WHEN size(split({time}, ':')) = 3 THEN coalesce(CAST(floor({part(0)}) * 3600 + floor({part(1)}) * 60 + floor({part(2)}) AS INT), 0) ELSE 0 END)"


def interval_main(seconds_of_day: str) -> str:
    """Half hours since 9:30, 0 to 7."""
    s = seconds_of_day
    return f"(CASE WHEN {s} >= 34200 THEN CAST(least(floor(({s} - 34200) / 1800), 7) AS INT) ELSE 0 END)"


def interval_report(seconds_of_day: str) -> str:
    """0 before 10:30, then 1 + half hours since, up to 7."""
    s = seconds_of_day
    return f"(CASE WHEN {s} < 37800 THEN 0 ELSE CAST(least(floor(({s} - 37800) / 1800) + 1, 7) AS INT) END)"


def mid_price(bid: str, ask: str) -> str:
    """Middle of both sides, the one that is there, or NULL; a side at 0 or missing is empty."""
    return f"(CASE WHEN coalesce({bid}, 0) <> 0 AND coalesce({ask}, 0) <> 0 THEN ({bid} + {ask}) / 2 WHEN coalesce({bid}, 0) = 0 AND coalesce({ask}, 0) <> 0 THEN {ask} WHEN coalesce({ask}, 0) = 0 AND coalesce({bid}, 0) <> 0 THEN {bid} END)"


def direction(change: str, alpha: float) -> str:
    """0 down, 2 up, 1 flat, NULL without a future price; strict at the band's edges."""
    return f"(CASE WHEN ({change}) < -{alpha!r} THEN 0 WHEN ({change}) > {alpha!r} THEN 2 WHEN ({change}) IS NOT NULL THEN 1 END)"


def at_limit(ask: str = "n_ask1", bid: str = "n_bid1", close: str = "n_close", limit: float = 0.095) -> str:
    return f"coalesce({ask} = 0 OR {bid} = 0 OR {close} >= {limit} OR {close} <= -{limit}, false)"
