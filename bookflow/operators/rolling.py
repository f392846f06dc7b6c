"""Moving averages, sums, deviations, least and largest values at a cost a row that doesn't grow with the frame.

Spark computes a moving frame anew for each row. Here a group's column is cut into blocks as long as the frame, so a frame is the
end of one block and the start of the next: running values from each block's start and from its end, two numbers a row, give
every frame. Nothing is ever subtracted from a longer sum, so no digits are lost however long a group is; deviations are
about a value of each part, and the two parts are put together from their means and squared deviations.

A catalogue's stage takes this way when its frames are long or many enough (``WORTH``); lags of the stage come along, so it has
no other window left. Sorted rows stream through in batches of many short groups or of parts of a long one; of the group that
a batch leaves open the last rows that frames can reach are kept, so no group is ever whole in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bookflow.functions import windows as w

#: Ticks of all frames of a stage together from which blocks are worth their way through Arrow.
WORTH = 150
FUNCTIONS = ("avg", "sum", "min", "max", "stddev_samp", "count", "lag")
Call = tuple[str, str, int, int]  # function, argument, ticks of the frame, ticks between its end and the row


def calls_of(stage: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], dict[str, Call]]:
    """The stage with its moving windows replaced by names, and these; nothing is replaced if a window of another kind is there."""
    names: dict[Call, str] = {}

    def name(found) -> str:
        function, inside, _, start, end = found.groups()
        if function == "lag":
            argument, _, k = inside.rpartition(",")
            call = (function, argument.strip(), 1, int(k))
        else:
            call = (function, inside.strip(), int(start) - int(end or 0) + 1, int(end or 0))
        return names.setdefault(call, f"__moving{len(names)}")

    if any(m[1] not in FUNCTIONS or (m[1] == "lag") != (m[4] is None) for _, e in stage for m in w.CALL.finditer(e)):
        return stage, {}
    replaced = [(n, w.CALL.sub(name, e)) for n, e in stage]
    if any(" OVER (" in e for _, e in replaced):
        return stage, {}
    return replaced, {n: call for call, n in names.items()}


def worth(calls: dict[str, Call]) -> bool:
    return sum(size for function, _, size, _ in calls.values() if function != "lag") >= WORTH


class Layout:
    """Rows of several groups, ``starts`` saying where each begins, in blocks of ``size``: every group starts a block of its own."""

    def __init__(self, starts: np.ndarray, rows: int, size: int):
        lengths = np.diff(np.r_[starts, rows])
        blocks = -(-lengths // size)
        first = np.repeat((np.cumsum(blocks) - blocks) * size, lengths)
        place = np.arange(rows) - np.repeat(starts, lengths)
        self.size, self.cells, self.at, self.place = size, int(blocks.sum()) * size, first + place, place
        #: Rows whose frame begins inside an earlier block, and the cell where.
        self.both = np.flatnonzero((place >= size) & (place % size != size - 1))
        self.begin = self.at[self.both] - size + 1

    def spread(self, x: np.ndarray) -> np.ndarray:
        out = np.full(self.cells, np.nan)
        out[self.at] = x
        return out.reshape(-1, self.size)


class Blocks:
    """A column laid out in blocks; NaN is no value."""

    def __init__(self, x: np.ndarray, layout: Layout):
        self.layout, self.x = layout, layout.spread(x)
        self.at, self.both, self.begin = layout.at, layout.both, layout.begin
        self.known = ~np.isnan(self.x)

    def put(self, fold, values: np.ndarray, join) -> np.ndarray:
        """Each frame's value: from its block's start to the row, joined with that from the frame's start to its block's end."""
        out = fold(values).ravel()[self.at]
        ends = fold(values[:, ::-1])[:, ::-1].ravel()
        out[self.both] = join(ends[self.begin], out[self.both])
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        return self.put(lambda v: np.cumsum(v, axis=1), values, np.add)

    def counts(self) -> np.ndarray:
        return self.sums(self.known.astype(float))

    def total(self) -> np.ndarray:
        return self.sums(np.where(self.known, self.x, 0.0))

    def extreme(self, function: np.ufunc) -> np.ndarray:
        return self.put(lambda v: function.accumulate(v, axis=1), self.x, function)

    def deviation(self) -> np.ndarray:
        """Sample deviations; NaN for one value."""
        with np.errstate(all="ignore"):

            def parts(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """(values, mean, squared deviations from it) up to each row of a block, taken about the first value there is: each of these
                parts holds it, so what lies far off elsewhere in the block takes no digits from it."""
                first = np.argmax(known, axis=1)[:, None]
                centre = np.where(np.take_along_axis(known, first, 1), np.take_along_axis(x, first, 1), 0.0)
                d = np.where(known, x - centre, 0.0)
                count, total = np.cumsum(known, axis=1).astype(float), np.cumsum(d, axis=1)
                mean = np.where(count > 0, total / count, 0.0)
                return count, mean + centre, np.maximum(np.cumsum(d * d, axis=1) - total * mean, 0.0)

            count, mean, squares = (p.ravel()[self.at] for p in parts(self.known, self.x))
            n0, m0, s0 = (p[:, ::-1].ravel()[self.begin] for p in parts(self.known[:, ::-1], self.x[:, ::-1]))
            n1, m1, s1 = (p[self.both] for p in (count, mean, squares))
            apart = np.where((n0 > 0) & (n1 > 0), (m1 - m0) ** 2 * n0 * n1 / np.maximum(n0 + n1, 1), 0.0)
            count[self.both], squares[self.both] = n0 + n1, s0 + s1 + apart
            return np.where(count > 1, np.sqrt(squares / (count - 1)), np.nan)


def moving(function: str, x: np.ndarray, layout: Layout, shift: int = 0) -> np.ndarray:
    """The function over the last rows of a group, as many as a block has, that end ``shift`` rows ago; NaN without a value."""
    if function == "lag":
        out = x
    else:
        blocks = Blocks(x, layout)
        if function == "count":
            out = blocks.counts()
        elif function in ("min", "max"):
            out = blocks.extreme(np.fmin if function == "min" else np.fmax)
        elif function == "stddev_samp":
            out = blocks.deviation()
        else:
            count = blocks.counts()
            with np.errstate(all="ignore"):
                out = np.where(count > 0, blocks.total() / (count if function == "avg" else 1), np.nan)
    if not shift:
        return out
    moved = np.concatenate([np.full(min(shift, len(x)), np.nan), out[: max(0, len(x) - shift)]])
    return np.where(layout.place >= shift, moved, 0.0 if function == "count" else np.nan)


def in_order(place: np.ndarray, last: int) -> np.ndarray:
    """Rows' places in their groups, which follow the last one before them or begin a group."""
    if ((place != 0) & (place != np.r_[last, place[:-1]] + 1)).any():
        raise ValueError("rows aren't in the order of their groups")
    return place


#: A tick's place in its group, from 0. Rows that have it come with each group in one task and in order.
AT = "__at"


def ordered(ticks: DataFrame) -> DataFrame:
    """Ticks dealt and sorted by group, with their places. Passes of :func:`streamed` and projections leave them so."""
    return ticks if AT in ticks.columns else ticks.selectExpr("*", f"{w.row_index()} AS {AT}")


class Moving:
    """A pass that adds moving windows by name. Numbers that the ticks have as columns don't travel twice."""

    def __init__(self, ticks: DataFrame, calls: dict[str, Call]):
        self.calls, self.reach = calls, max(size + shift for _, _, size, shift in calls.values())
        there = {f.name for f in ticks.schema.fields if f.dataType == T.DoubleType()}
        self.arguments = {a: a if a in there else f"__of{k}" for k, a in enumerate(dict.fromkeys(a for _, a, _, _ in calls.values()))}
        self.needs, self.adds = [f"CAST({a} AS DOUBLE) AS {n}" for a, n in self.arguments.items() if a != n], list(calls)

    def run(self, batches):
        halo, last = {n: np.empty(0) for n in self.arguments.values()}, -1
        for batch in batches:
            place = in_order(batch.column(AT).to_numpy(), last)
            held = len(next(iter(halo.values()))) if place[0] else 0  # rows before the batch, of the group that goes on
            columns = {n: np.concatenate([halo[n][len(halo[n]) - held :], batch.column(n).to_pandas().to_numpy(float)]) for n in self.arguments.values()}
            starts = np.unique(np.r_[0, held + np.flatnonzero(place == 0)])
            layouts = {size: Layout(starts, held + len(place), size) for _, _, size, _ in self.calls.values()}
            out = [moving(function, columns[self.arguments[a]], layouts[size], shift)[held:] for function, a, size, shift in self.calls.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.float64(), from_pandas=True) for x in out)], names=[*batch.schema.names, *self.calls])
            open_ = min(self.reach, int(place[-1]) + 1)
            halo, last = {n: c[len(c) - open_ :] for n, c in columns.items()}, place[-1]


def streamed(ticks: DataFrame, *passes) -> DataFrame:
    """Ticks with the columns that the passes add, in one stream: rows are dealt and sorted once, and not at all where they have
    their places already."""
    rows = ordered(ticks).selectExpr("*", *(e for p in passes for e in p.needs))
    schema = T.StructType([*ticks.schema.fields, *(T.StructField(n, T.DoubleType()) for p in passes for n in p.adds)])
    names = schema.names

    def run(batches):
        found = (b for b in batches if b.num_rows)
        for p in passes:
            found = p.run(found)
        for batch in found:
            yield batch.select(names)

    return rows.mapInArrow(run, schema)


def add(ticks: DataFrame, calls: dict[str, Call]) -> DataFrame:
    """Ticks with the named moving windows as columns."""
    return streamed(ticks, Moving(ticks, calls))
