"""Features of lone windows: what a model sees that is given the last ``length`` ticks alone, for every tick that ends such a window.

A window sees no tick before its first one. For almost all features that changes nothing, as they look back less far. Those
that look back further get frames cut at the window's start, one form for each of the ticks that the vector holds in full
(the tick k before the last has k ticks fewer behind it). Recursive averages start at the window's first value: all windows of
a group take a step at once, each step a view of the group's column moved by one tick, so ``length`` steps serve any number of
windows, and the last steps' values are those of the vector's ticks. No tick is copied for the windows that hold it: rows move
as they do for windows of a session.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.functions import windows as w
from bookflow.functions.exprs import clean
from bookflow.operators import features_main as main
from bookflow.operators.ewm import alpha_of
from bookflow.operators.rolling import in_order
from bookflow.operators.vector import RECENT, SUMMARY
from bookflow.plans.staged import Catalogue
from bookflow.schema import EPS, RAW

#: Fixed value: ticks of the stochastic oscillator's frame.
STOCHASTIC = 9


def limited(expression: str, ticks: int) -> str:
    """An expression over a session's windows as it is where only the last ``ticks`` ticks are there, this one included."""

    def cut(found: re.Match) -> str:
        function, inside, over, start, end = found.groups()
        if function == "lag":
            return found[0] if int(inside.rsplit(",", 1)[1]) < ticks else "CAST(NULL AS DOUBLE)"
        if start is None:
            raise ValueError(f"a window without a frame of ticks: {found[0]}")
        if int(end or 0) >= ticks:
            return "CAST(NULL AS DOUBLE)"
        to = f"{end} PRECEDING" if end else "CURRENT ROW"
        return f"{function}({inside}) OVER ({over} ROWS BETWEEN {min(int(start), ticks - 1)} PRECEDING AND {to})"

    return w.CALL.sub(cut, expression)


class Average:
    """y = a x + (1 - a) y of many windows at once, begun at each one's first value; missing values let the mean decay."""

    def __init__(self, windows: int, alpha: float):
        self.y, self.old, self.alpha = np.full(windows, np.nan), np.ones(windows), alpha

    def step(self, x: np.ndarray) -> np.ndarray:
        a, gap, fresh = self.alpha, np.isnan(x), np.isnan(self.y)
        if not gap.any() and not fresh.any() and (self.old == 1).all():
            self.y = (1 - a) * self.y + a * x
            return self.y
        old = np.where(fresh, 1.0, self.old * (1 - a))
        mixed = np.where(fresh, x, (old * self.y + a * x) / (old + a))
        self.y, self.old = np.where(gap, self.y, mixed), np.where(gap, np.where(fresh, 1.0, old), 1.0)
        return self.y


def recursions(mid: np.ndarray, rsv: np.ndarray, bid: np.ndarray, ask: np.ndarray, flow: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """By recursive feature: (windows, ticks) of the vector's ticks, the last first. Window k ends at tick k + length - 1."""
    count = len(mid) - length + 1
    fast, slow, signal = (Average(count, alpha_of(s)) for s in (12, 26, 9))
    k, d = Average(count, 1 / 3), Average(count, 1 / 3)
    five, ten = Average(count, alpha_of(5)), Average(count, alpha_of(10))
    out = {name: np.empty((count, len(RECENT))) for name in main.RECURSIVE}
    low, high = np.full(count, np.nan), np.full(count, np.nan)
    for p in range(length):
        now = slice(p, p + count)
        place = rsv[now]
        if p < STOCHASTIC - 1:  # fewer ticks than its frame
            low, high = np.fmin(low, bid[now]), np.fmax(high, ask[now])
            place = 100 * (mid[now] - low) / (high - low + EPS)
        dif = fast.step(mid[now]) - slow.step(mid[now])
        dea, kk = signal.step(dif), k.step(place)
        dd = d.step(kk)
        flows = flow[now] if p else np.zeros(count)  # a window's first tick has none before it
        found = {"macd_dif": dif, "macd_dea": dea, "macd_bar": dif - dea, "kdj_k": kk, "kdj_d": dd, "kdj_j": 3 * kk - 2 * dd, "ofi_ema_5": five.step(flows), "ofi_ema_10": ten.step(flows)}
        if (back := length - 1 - p) < len(RECENT):
            for name, values in found.items():
                out[name][:, back] = values
    return out


def with_recursions(ticks: DataFrame, length: int) -> DataFrame:
    """Ticks with each recursive feature as an array over the vector's ticks, NULL where no window ends.

    Sorted rows stream through; of the group that a batch leaves open the ticks of a window less one are kept.
    """
    names = ("n_midprice", "rsv", "n_bid1", "n_ask1", "ofi_1")
    schema = T.StructType(ticks.schema.fields + [T.StructField(f"alone_{n}", T.ArrayType(T.DoubleType())) for n in main.RECURSIVE])
    rows = ticks.selectExpr("*", f"{w.row_index()} AS __at")

    def run(batches):
        held, last = [np.empty(0)] * len(names), -1
        for batch in batches:
            if not batch.num_rows:
                continue
            place = in_order(batch.column(batch.num_columns - 1).to_numpy(), last)
            columns = [batch.column(n).to_pandas().to_numpy(float) for n in names]
            edges = [0, *(np.flatnonzero(place[1:] == 0) + 1).tolist(), len(place)]
            missing, found = np.ones(len(place), bool), {n: [] for n in main.RECURSIVE}
            for a, b in pairwise(edges):
                parts = [np.concatenate([h, c[a:b]]) if place[a] else c[a:b] for h, c in zip(held, columns)]
                if len(parts[0]) >= length:
                    for n, values in recursions(*parts, length).items():
                        found[n].append(values)
                    missing[b - (len(parts[0]) - length + 1) : b] = False
                held = [p[max(0, len(p) - length + 1) :] for p in parts]
            last = place[-1]
            offsets = pa.array(np.r_[0, np.cumsum(~missing) * len(RECENT)].astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty((0, len(RECENT))), *found[n]]).ravel()), mask=pa.array(missing)) for n in main.RECURSIVE]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *(f"alone_{n}" for n in main.RECURSIVE)])

    return rows.mapInArrow(run, schema)


def window_vectors(ticks: DataFrame, length: int = 100) -> DataFrame:
    """The key columns and ``vector`` of every tick that ends a window of ``length`` ticks, as of that window alone."""
    keys = [c for c in ticks.columns if c not in RAW]
    local, looking_back, nested = main.CATALOGUE.stages
    seeds = main.CATALOGUE.needed(["rsv", "ofi_1"])
    walked = with_recursions(seeds.apply(ticks), length)
    done = set(seeds.names())
    forms: dict[str, list[str]] = {}  # a feature's column for each tick of the vector
    stages: list[list[tuple[str, str]]] = []
    for stage in (local, looking_back, nested):
        kept = []
        for name, expression in (x for x in stage if x[0] not in done):
            texts = [limited(expression, length - k) for k in RECENT]
            if len(set(texts)) == 1 and texts[0] == expression:
                kept.append((name, expression))
                continue
            forms[name] = [f"{name}__{k}" for k in RECENT]
            kept += [(column, text) for column, text in zip(forms[name], texts)]
        stages.append(kept)
    wide = Catalogue(stages).apply(walked)
    number = lambda c: f"CAST({clean(f'CAST({c} AS DOUBLE)')} AS FLOAT)"
    plain = [c for c in main.FEATURES if c not in main.RECURSIVE]
    packed = wide.selectExpr(*keys, *(f"alone_{c}" for c in main.RECURSIVE), f"{w.row_index()} AS __idx", *(f"{number(x)} AS __{n}" for n, x in (("mid", "n_midprice"), ("imb", "total_imbalance"))), *(f"array({', '.join(number(forms[c][k] if c in forms else c) for c in plain)}) AS now_{k}" for k in RECENT))
    back = {(n, k): w.lag(f"__{n}", min(k, length - 1)) for k in SUMMARY for n in ("mid", "imb")}
    held = packed.selectExpr(*keys, "__idx", *(f"alone_{c}" for c in main.RECURSIVE), *(f"{w.lag(f'now_{k}', k) if k else 'now_0'} AS then_{k}" for k in RECENT), f"array({', '.join(back[n, k] for k in SUMMARY for n in ('mid', 'imb'))}) AS far")
    parts = []
    for k in RECENT:
        at = run = 0
        for c in main.FEATURES:  # stretches of plain features between recursive ones
            if c in main.RECURSIVE:
                parts += [f"slice(then_{k}, {at + 1}, {run})"] if run else []
                parts.append(f"array({number(f'alone_{c}[{k}]')})")
                at, run = at + run, 0
            else:
                run += 1
        parts += [f"slice(then_{k}, {at + 1}, {run})"] if run else []
    ends = held.filter(F.col("__idx") >= length - 1)
    return ends.selectExpr(*keys, f"concat({', '.join([*parts, 'far'])}) AS vector")
