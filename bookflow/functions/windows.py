"""Window expressions over ticks as SQL text. All share one window specification, so Spark plans one exchange and one sort.

A tick's window is its (sym, date, session); ``row_nr`` is the order of ticks in it.
"""

from __future__ import annotations

import re

from bookflow.functions.exprs import div
from bookflow.schema import GROUP

OVER = f"PARTITION BY {', '.join(GROUP)} ORDER BY row_nr"

#: A call over such a window: function, arguments, what is before the frame, the frame's start and, unless it ends here, its end.
CALL = re.compile(r"\b(\w+)\(((?:[^()]|\([^()]*\))*)\) OVER \(([^()]*?ORDER BY row_nr)(?: ROWS BETWEEN (\d+) PRECEDING AND (?:(\d+) PRECEDING|CURRENT ROW))?\)")


def frame(k: int) -> str:
    """The last k ticks, this one included."""
    return f"OVER ({OVER} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({OVER})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER ({OVER})"


def diff(x: str, k: int = 1) -> str:
    return f"({x} - {lag(x, k)})"


def rolling(function: str, x: str, k: int) -> str:
    """avg, sum, min, max or stddev_samp over the last k ticks, however few there are."""
    return f"{function}({x}) {frame(k)}"


def rolling_full(function: str, x: str, k: int) -> str:
    """As :func:`rolling`, NULL unless all k values are there."""
    return f"(CASE WHEN count({x}) {frame(k)} = {k} THEN {rolling(function, x, k)} END)"


def shifted_mean(x: str, size: int, shift: int) -> str:
    """Mean of ``size`` ticks that end ``shift`` ticks ago."""
    return f"avg({x}) OVER ({OVER} ROWS BETWEEN {shift + size - 1} PRECEDING AND {shift} PRECEDING)"


def first(x: str) -> str:
    return f"first_value({x}) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def clamped(x: str, k: int) -> str:
    """The value k ticks ago, or the group's first. Apply to cleaned columns only: NULL means before the first tick here."""
    return f"coalesce({lag(x, k)}, {first(x)})"


def zscore(x: str, k: int, eps: float = 1e-10) -> str:
    return div(f"{x} - {rolling('avg', x, k)}", f"{rolling('stddev_samp', x, k)} + {eps!r}D")


def slope(x: str, k: int, eps: float = 1e-10) -> str:
    """Mean of the last third less the mean of the first third of k ticks, by tick."""
    third, shift = k // 3, 2 * k // 3
    return div(f"{rolling('avg', x, third)} - {shifted_mean(x, third, shift)}", f"{shift} + {eps!r}D")


def row_index() -> str:
    return f"(row_number() OVER ({OVER}) - 1)"
