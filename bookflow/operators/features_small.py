"""Two small inputs: 43 features of a window's last tick, and raw columns for window flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bookflow.functions import windows as w
from bookflow.functions.exprs import clean, div, ln1p
from bookflow.plans.staged import Catalogue
from bookflow.schema import LEVELS, RAW

# Lengths of the moving averages.
MEANS = (5, 10, 20, 40, 60)


def _ln(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ln({x}) END)"


def _of(name: str, function) -> list[tuple[str, str]]:
    """A feature of levels 1 to 3; the first level has no number."""
    return [(f"{name}{'' if i == 1 else i}", function(i)) for i in (1, 2, 3)]


#: Prices are changes against the day before; +1 makes them ratios again.
PRICES = [(f"{s}{i}", f"(n_{s}{i} + 1)") for s in ("bid", "ask") for i in LEVELS]
ROWS = (
    _of("spread", lambda i: f"(ask{i} - bid{i})")
    + _of("mid_price", lambda i: f"((ask{i} + bid{i}) / 2)")
    + [(f"weighted_ab{i}", div(f"ask{i}*n_bsize{i} + bid{i}*n_asize{i}", f"n_asize{i} + n_bsize{i}")) for i in (1, 2, 3)]
    + _of("relative_spread", lambda i: div(f"ask{i} - bid{i}", f"(ask{i} + bid{i}) / 2"))
    + [(f"{s}{i}", _ln(f"n_{s}{i}")) for s in ("bsize", "asize") for i in LEVELS]
    + [("amount", ln1p("amount_delta"))]
)
WINDOWS = [(f"{s}1_ma{k}", w.rolling("avg", f"{s}1", k)) for s in ("ask", "bid") for k in MEANS]
CATALOGUE = Catalogue([PRICES, ROWS, WINDOWS])
FEATURES = CATALOGUE.names()


def features(ticks: DataFrame) -> DataFrame:
    keys = [c for c in ticks.columns if c not in RAW]
    return CATALOGUE.apply(ticks).selectExpr(*keys, *(f"{clean(c)} AS {c}" for c in FEATURES))
