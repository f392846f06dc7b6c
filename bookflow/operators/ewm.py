"""Exponentially weighted means, y = a*x + (1-a)*y, started at the first value.

Sorted rows stream through in batches of many short groups or of parts of a long one; of the group that a batch leaves open only
the last means are kept, so no group is ever whole in memory. Missing values: the mean decays through them and is renormalised
when the next value comes.

Where one group may be too long for one task, :func:`scan` cuts them into stretches that spread over all tasks. One stretch turns the mean
at its start into that at its end by an affine map, whatever the values in it; so every stretch is first reduced to its map (a
row), the maps of a group's stretches are composed in order, and each stretch runs again from its own start.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.functions import windows as w
from bookflow.operators.rolling import AT, in_order, streamed
from bookflow.schema import GROUP

#: Ticks of a stretch.
STRETCH = 100_000


def alpha_of(span: float) -> float:
    return 2.0 / (span + 1.0)


def ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    return walked(x, alpha)[0]


def walked(x: np.ndarray, alpha: float, y: float = np.nan, old: float = 1.0) -> tuple[np.ndarray, float]:
    """The means that follow a mean ``y`` (NaN: there is none yet) of which missing values have left ``old``, and what is left of the
    last one. Walking on from the last mean gives what walking the whole column at once does."""
    x = np.asarray(x, float)
    kept, out = 1 - alpha, x.tolist()
    if old == 1.0 and not np.isnan(x).any():
        for k, v in enumerate(out):
            if y == y:
                v = kept * y + alpha * v
            out[k] = y = v
        return np.array(out), 1.0
    for k, v in enumerate(out):
        if y != y:
            y, old = v, 1.0
        elif v != v:
            old *= kept
        else:
            y, old = (kept * y + alpha * v if old == 1.0 else (old * kept * y + alpha * v) / (old * kept + alpha)), 1.0
        out[k] = y
    return np.array(out), old


#: (name, function of the columns at hand), in order; spans and weights are fixed values.
RECURSIONS = (
    ("macd_dif", lambda d: d.mean("n_midprice", alpha_of(12)) - d.mean("n_midprice", alpha_of(26))),
    ("macd_dea", lambda d: d.mean("macd_dif", alpha_of(9))),
    ("macd_bar", lambda d: d["macd_dif"] - d["macd_dea"]),
    ("kdj_k", lambda d: d.mean("rsv", 1 / 3)),
    ("kdj_d", lambda d: d.mean("kdj_k", 1 / 3)),
    ("kdj_j", lambda d: 3 * d["kdj_k"] - 2 * d["kdj_d"]),
    ("ofi_ema_5", lambda d: d.mean("ofi_1", alpha_of(5))),
    ("ofi_ema_10", lambda d: d.mean("ofi_1", alpha_of(10))),
)


def recursive_features(ticks: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``ticks`` with the recursive features (all, or those named and what they need). Needs row_nr; rsv and ofi_1 where used."""
    wanted = [r for r in RECURSIONS if names is None or any(n.split("_")[0] == r[0].split("_")[0] for n in names)]
    return _with_columns(ticks, wanted)


def smooth(ticks: DataFrame, column: str, alphas: dict[str, float]) -> DataFrame:
    """Means of one column by name and weight, one pass over each group."""
    return _with_columns(ticks, [(name, lambda d, a=alpha: d.mean(column, a)) for name, alpha in alphas.items()])


class _Walk(dict):
    """Columns of the batch at hand as arrays, converted when they are asked for, and means over them by group. Of the group that a
    batch leaves open, the last means are kept for the next one."""

    def __init__(self):
        super().__init__()
        self.last: dict[tuple[str, float], tuple[float, float]] = {}

    def take(self, batch: pa.RecordBatch, place: np.ndarray) -> None:
        self.clear()
        self.batch, self.edges = batch, [0, *(np.flatnonzero(place[1:] == 0) + 1).tolist(), len(place)]
        if not place[0]:
            self.last = {}

    def __missing__(self, name: str) -> np.ndarray:
        self[name] = self.batch.column(name).to_pandas().to_numpy(float)
        return self[name]

    def mean(self, name: str, alpha: float) -> np.ndarray:
        x, (y, old) = self[name], self.last.get((name, alpha), (np.nan, 1.0))
        parts = []
        for a, b in pairwise(self.edges):
            part, old = walked(x[a:b], alpha, y if not a else np.nan, old if not a else 1.0)
            parts.append(part)
        self.last[name, alpha] = float(part[-1]), old
        return np.concatenate(parts)


class Recursion:
    """A pass (see :mod:`bookflow.operators.rolling`) that adds means along each group, given as (name, function of the columns at
    hand). Other columns pass through as Arrow data, unconverted."""

    needs: tuple[str, ...] = ()

    def __init__(self, added: tuple | list = RECURSIONS):
        self.added, self.adds = added, [n for n, _ in added]

    def run(self, batches):
        walk, last = _Walk(), -1
        for batch in batches:
            place = in_order(batch.column(AT).to_numpy(), last)
            walk.take(batch, place)
            for name, function in self.added:
                walk[name] = function(walk)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(walk[n], pa.float64(), from_pandas=True) for n in self.adds)], names=[*batch.schema.names, *self.adds])
            last = place[-1]


def _with_columns(ticks: DataFrame, added: list[tuple]) -> DataFrame:
    """Add columns that are means along each group in row order."""
    return streamed(ticks, Recursion(added))


def reduced(x: np.ndarray, alpha: float) -> tuple[int, float | None, float, float, int]:
    """A stretch as (missing values before the first one, that value, slope, offset, missing values after the last one): the mean
    at the last value is slope times the mean at the first one, plus offset."""
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return len(x), None, 1.0, 0.0, len(x)
    # What is left of the mean before each further value: it has decayed once, and once more for each missing value.
    old = (1 - alpha) ** np.diff(at)
    keeps, gains = old / (old + alpha) if len(at) < len(x) else old, alpha / (old + alpha) if len(at) < len(x) else np.full(len(old), alpha)
    after = np.append(np.cumprod(keeps[::-1])[::-1], 1.0)  # what later values leave of each one
    return int(at[0]), float(x[at[0]]), float(after[0]), float((gains * x[at[1:]] * after[1:]).sum()), int(len(x) - 1 - at[-1])


def starts(maps: pd.DataFrame, alphas: dict[str, float]) -> pd.DataFrame:
    """For each stretch of a group the mean and the missing values before it, from the maps in order."""
    out = maps[[*GROUP, "stretch"]].copy()
    for name, alpha in alphas.items():
        y, gap, before = np.nan, 0, []
        for lead, first, slope, offset, tail, size in maps[[f"{f}_{name}" for f in ("lead", "first", "slope", "offset", "tail")] + ["size"]].itertuples(index=False):
            before.append((y, gap))
            if np.isnan(first):
                gap += 0 if np.isnan(y) else size
                continue
            old = (1 - alpha) ** (gap + lead + 1)
            y = slope * (first if np.isnan(y) else (old * y + alpha * first) / (old + alpha)) + offset
            gap = tail
        out[f"y_{name}"], out[f"gap_{name}"] = [b[0] for b in before], [b[1] for b in before]
    return out


def scan(ticks: DataFrame, column: str, alphas: dict[str, float], stretch: int | None = None) -> DataFrame:
    """As :func:`smooth`, for groups of any length: stretches of ticks in parallel, a row for each of them in between. Groups of
    one stretch have nothing to compose."""
    size = stretch or STRETCH
    rows = ticks.selectExpr("*", f"CAST(floor({w.row_index()} / {size}) AS BIGINT) AS __stretch", f"count(*) OVER (PARTITION BY {', '.join(GROUP)}) > {size} AS __long").repartition(*GROUP, "__stretch")
    fields = [T.StructField(g, ticks.schema[g].dataType) for g in GROUP]
    shapes = [T.StructField("stretch", T.LongType()), T.StructField("size", T.LongType())]
    parts = (("lead", T.LongType()), ("first", T.DoubleType()), ("slope", T.DoubleType()), ("offset", T.DoubleType()), ("tail", T.LongType()))
    shapes += [T.StructField(f"{part}_{name}", kind) for name in alphas for part, kind in parts]

    def reduce_(table: pa.Table) -> pa.Table:
        x = table.sort_by("row_nr").column(column).to_pandas().to_numpy(float)
        out = {g: [table.column(g)[0].as_py()] for g in GROUP} | {"stretch": [table.column("__stretch")[0].as_py()], "size": [len(x)]}
        for name, alpha in alphas.items():
            out |= {f"{part}_{name}": [v] for (part, _), v in zip(parts, reduced(x, alpha))}
        return pa.Table.from_pydict(out, schema=_arrow(T.StructType(fields + shapes)))

    def compose(maps: pd.DataFrame) -> pd.DataFrame:
        return starts(maps.sort_values("stretch"), alphas)

    begun = T.StructType([*fields, T.StructField("stretch", T.LongType()), *(T.StructField(f"{part}_{name}", kind) for name in alphas for part, kind in (("y", T.DoubleType()), ("gap", T.LongType())))])
    maps = rows.filter("__long").select(*GROUP, "__stretch", "row_nr", column).groupBy(*GROUP, "__stretch").applyInArrow(reduce_, T.StructType(fields + shapes))
    before = maps.groupBy(*GROUP).applyInPandas(compose, begun).withColumnRenamed("stretch", "__stretch")
    joined = rows.join(before, [*GROUP, "__stretch"], "left")
    # A stretch's rows in one task and in order, whatever way the join went.
    placed = joined.selectExpr(*(f"`{c}`" for c in ticks.columns), *(f"{part}_{name}" for name in alphas for part in ("y", "gap")), f"(row_number() OVER (PARTITION BY {', '.join(GROUP)}, __stretch ORDER BY row_nr) - 1) AS __place")
    kept = len(ticks.columns)

    def replay(batches):
        held, last = dict.fromkeys(alphas, (np.nan, 1.0)), -1
        for batch in batches:
            if not batch.num_rows:
                continue
            number = lambda n: batch.column(n).to_pandas().to_numpy(float)
            place = in_order(number("__place"), last)
            edges, x, out = [0, *(np.flatnonzero(place[1:] == 0) + 1).tolist(), len(place)], number(column), []
            for name, alpha in alphas.items():
                begun_, gaps, parts = number(f"y_{name}"), np.nan_to_num(number(f"gap_{name}")), []
                for a, b in pairwise(edges):
                    y, old = (begun_[a], (1 - alpha) ** gaps[a]) if place[a] == 0 else held[name]
                    part, old = walked(x[a:b], alpha, y, old)
                    held[name] = float(part[-1]), old
                    parts.append(part)
                out.append(pa.array(np.concatenate(parts), pa.float64(), from_pandas=True))
            last = place[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *out], names=[*batch.schema.names[:kept], *alphas])

    schema = T.StructType(ticks.schema.fields + [T.StructField(n, T.DoubleType()) for n in alphas])
    return placed.mapInArrow(replay, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
