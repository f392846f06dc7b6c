"""Gradient-boosted trees for three classes with the softmax objective, trained on a binned store by distributed histograms.

A round grows one tree a class from the same probabilities: gradient p - y, Hessian 2 p (1 - p), times the row's weight. A
level of the three trees is one job: each task sums gradients and Hessians by node, feature and bin; sums of a slice of
features meet in one task, which gives the slice's best split; the driver sees a row for each node and slice. Rows never move.
A task's sums are bounded by ``HISTOGRAM_BYTES``: a level with more nodes takes several jobs.

Sums are integers (gradients in steps of 2**-24), so they don't depend on the order of rows, tasks or retries, and the
same rows give the same trees. A row's margins come from the table last written plus the trees since; every ``REFRESH`` rounds
the table is written anew in shared storage, which also cuts the lineage.

The loss over validation rows is taken in the next round's first job. Training ends when it hasn't fallen for ``patience``
rounds, and the trees up to the best round stay. Every ``save_every`` rounds all trees are saved; a run that finds such a
state continues from it and ends with the trees of a run that never stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.operators.binned import Store, binary_rows, byte_matrix, matrix
from bookflow.runtime import remove, scratch

CLASSES = 3
#: Gradients and losses are summed in steps of 1 / SCALE.
SCALE = 1 << 24
#: Features whose sums travel together; bytes of a task's sums; rounds between two writes of margins.
SLICE, HISTOGRAM_BYTES, REFRESH = 64, 256 << 20, 16
#: Training and validation rows between rounds: columns of many rows each as bytes, which costs Spark a record a block and not a row.
BLOCK = "validation boolean, row binary, label binary, weight binary, bins binary, margins binary"
BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20
SUMS = "cls int, node int, slice int, sums binary"
BEST = "cls int, node int, feature int, cut int, gain double, left_g long, left_h long, g long, h long"


@dataclass
class Options:
    """Settings of a run. A row's weight is its class weight, if those are on, times a clipped weight of its move, if ``profit`` is
    given (base, alpha, low, high). ``lasso`` and ``ridge`` hold leaves down by their size and its square."""

    rounds: int = 2000
    patience: int = 100
    depth: int = 8
    rate: float = 0.05
    lasso: float = 10.0
    ridge: float = 2.0
    least_hessian: float = 50.0
    least_gain: float = 0.5
    rows: float = 0.6
    columns: float = 0.4
    save_every: int = 250
    seed: int = 42
    class_weights: bool = True
    profit: tuple[float, float, float, float] | None = None


#: The published parameter sets by name.
PRESETS = {
    "report_pdf": {"depth": 6, "rate": 0.3, "lasso": 0.0, "ridge": 1.0, "least_hessian": 1.0, "least_gain": 0.0, "rows": 1.0, "columns": 1.0, "class_weights": False},
    "previous_code": {"depth": 8, "rate": 0.05, "lasso": 10.0, "ridge": 2.0, "least_hessian": 50.0, "least_gain": 0.5, "rows": 0.6, "columns": 0.4, "class_weights": True},
    "legacy_1225": {"depth": 7, "rate": 0.05, "lasso": 5.0, "ridge": 2.0, "least_hessian": 50.0, "least_gain": 0.5, "rows": 0.7, "columns": 0.4, "class_weights": True},
}


@dataclass
class Tree:
    """Node k has children 2k and 2k + 1, the root is 1; ``feature`` is -1 at leaves. Values over ``cut`` go right."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    leaf: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 << depth
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.float32), np.zeros(size))

    def places(self, x: np.ndarray, by_value: bool = False) -> np.ndarray:
        """The node each row ends in, by bins or by values."""
        at = np.ones(len(x), np.int64)
        cut, inner, asked = self.value if by_value else self.cut, self.feature >= 0, np.maximum(self.feature, 0)
        flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for depth in range(len(self.feature).bit_length() - 2):
            level = inner[1 << depth : 2 << depth]
            if not level.any():
                break
            below = 2 * at + (flat.take(first + asked.take(at)) > cut.take(at))
            at = below if level.all() else np.where(inner.take(at), below, at)
        return at


def margins(x: np.ndarray, rounds: list[list[Tree]], start: np.ndarray | None = None, by_value: bool = False) -> np.ndarray:
    out = np.zeros((len(x), CLASSES)) if start is None else start.copy()
    for trees in rounds:
        for c, tree in enumerate(trees):
            out[:, c] += tree.leaf[tree.places(x, by_value)]
    return out


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(p: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians of the weighted logarithmic loss by class, in steps of 1 / SCALE."""
    g = p.copy()
    g[np.arange(len(p)), label] -= 1
    h = np.maximum(2 * p * (1 - p), 1e-16)
    return np.rint(g * weight[:, None] * SCALE), np.rint(h * weight[:, None] * SCALE)


def drawn(row: np.ndarray, round_: int, seed: int, share: float) -> np.ndarray:
    """Which rows a round's trees see: by a hash of row, round and seed."""
    if share >= 1:
        return np.ones(len(row), bool)
    x = row.astype(np.uint64) + np.uint64((round_ * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x < np.uint64(min(2**64 - 1, int(share * 2**64)))


def best_cut(sums: np.ndarray, o: Options) -> tuple[int, int, float, int, int] | None:
    """(feature, cut, gain, left gradient, left Hessian) of the best split of (features, bins, 2) sums; the first of equals."""
    left = sums.cumsum(axis=1)[:, :-1]
    total = sums[0].sum(axis=0)
    score = lambda s: np.maximum(np.abs(s[..., 0] / SCALE) - o.lasso, 0) ** 2 / (s[..., 1] / SCALE + o.ridge)
    right = total - left
    gain = score(left) + score(right) - score(total)
    gain[(left[..., 1] < o.least_hessian * SCALE) | (right[..., 1] < o.least_hessian * SCALE)] = -np.inf
    if not gain.size or not gain.max() > o.least_gain:
        return None
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return int(f), int(b), float(gain[f, b]), int(left[f, b, 0]), int(left[f, b, 1])


@dataclass
class Booster:
    options: Options = field(default_factory=Options)
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  # validation loss after 0, 1, ... rounds

    # Training.
    def fit(self, store: Store, state: str | None = None, stop_after: int | None = None) -> Booster:
        """Train to the end. ``state``: a folder for saved rounds, from which training continues; ``stop_after``: leave early, as a
        run does that is ended from outside (tests)."""
        spark, o = store.spark, self.options
        if state and (saved := saved_rounds(spark, state)):
            self.rounds, self.losses = read_rounds(spark, f"{state}/rounds={saved[-1]}")
        current = self._margins(store, store.rows, self.rounds)
        written = len(self.rounds)
        while len(self.rounds) < o.rounds:
            if len(self.rounds) - written >= REFRESH:
                current, old = self._margins(store, current[0], self.rounds[written:]), current[1]
                remove(spark, old)
                written = len(self.rounds)
            trees, loss = self._round(store, current[0], self.rounds[written:])
            if len(self.losses) == len(self.rounds):
                self.losses.append(loss)
            if self._stale():
                break
            self.rounds.append(trees)
            if state and len(self.rounds) % o.save_every == 0:
                write_rounds(spark, f"{state}/rounds={len(self.rounds)}", self.rounds, self.losses)
            if len(self.rounds) == stop_after:
                break
        else:
            if len(self.losses) == len(self.rounds):
                self.losses.append(self._loss(store, current[0], self.rounds[written:]))
        remove(spark, current[1])
        if stop_after is None:
            self.rounds = self.rounds[: self.best_round()]
        return self

    def best_round(self) -> int:
        """The rounds with the least validation loss, the first of equals; all of them without validation rows."""
        return len(self.rounds) if not self.losses or np.isnan(self.losses).any() else int(np.argmin(self.losses))

    def _stale(self) -> bool:
        return not np.isnan(self.losses).any() and len(self.losses) - 1 - int(np.argmin(self.losses)) >= self.options.patience

    def _weights(self, store: Store):
        """A function of labels and moves: class weights from the training rows' counts, times the move's weight."""
        counts = np.array(store.counts(), float)
        by_class = np.where(counts > 0, counts.sum() / (max(1, (counts > 0).sum()) * np.maximum(counts, 1)), 1.0) if self.options.class_weights else np.ones(CLASSES)
        profit, move = self.options.profit, store.manifest["mean_move"]

        def weight(label: np.ndarray, price_diff: np.ndarray, validation: np.ndarray) -> np.ndarray:
            out = by_class[label]
            if profit:
                base, alpha, low, high = profit
                out = out * np.where(validation, 1.0, np.clip(base + alpha * np.abs(price_diff) / (move + 1e-10), low, high))
            return out

        return weight

    def _margins(self, store: Store, rows: DataFrame, rounds: list[list[Tree]]) -> tuple[DataFrame, str]:
        """The rows with margins after these rounds, written anew as blocks (``BLOCK``) that hold validation rows alone or none."""
        held, weight = store.spark.sparkContext.broadcast(rounds), self._weights(store)
        width, known = len(store.cuts), "margins" in rows.columns

        def first(batches):
            for batch in batches:
                c = dict(zip(batch.schema.names, batch.columns))
                row, label, move, validation = (c[n].to_numpy(zero_copy_only=False) for n in ("row", "label", "price_diff", "validation"))
                x, w = byte_matrix(c["bins"], np.uint8), weight(label, move, validation)
                for flag in (False, True):
                    at = np.flatnonzero(validation == flag)
                    for a in range(0, len(at), size := max(1, min(BLOCK_ROWS, BLOCK_BYTES // (width + 48)))):
                        own = at[a : a + size]
                        yield flag, row[own], label[own], w[own], x[own], None

        def run(batches):
            for flag, row, label, w, x, m in _blocks(batches, width) if known else first(batches):
                columns = (row.astype("<i8"), label.astype("<i4"), w.astype("<f8"), np.ascontiguousarray(x), margins(x, held.value, m).astype("<f8"))
                yield pa.RecordBatch.from_arrays([pa.array([flag]), *(pa.array([v.tobytes()], pa.binary()) for v in columns)], names=[f.split()[0] for f in BLOCK.split(", ")])

        path = scratch(store.spark, "margins")
        # A reader takes a row group as a batch, whatever its bytes.
        rows.mapInArrow(run, BLOCK).write.option("compression", "zstd").option("parquet.block.row.count.limit", 8).parquet(path)
        held.destroy()
        return store.spark.read.schema(BLOCK).parquet(path), path

    def _loss(self, store: Store, rows: DataFrame, since: list[list[Tree]]) -> float:
        return self._level(store, rows, since, [Tree.empty(0)] * CLASSES, {}, [[]] * CLASSES, 0, True)[1]

    def _round(self, store: Store, rows: DataFrame, since: list[list[Tree]]) -> tuple[list[Tree], float]:
        o, number, width = self.options, len(self.rounds), len(store.cuts)
        rng = np.random.default_rng([o.seed, number])
        features = [sorted(rng.choice(width, max(1, round(o.columns * width)), replace=False).tolist()) for _ in range(CLASSES)]
        trees = [Tree.empty(o.depth) for _ in range(CLASSES)]
        active: list[tuple[int, int]] = [(c, 1) for c in range(CLASSES)]
        loss = float("nan")
        for depth in range(o.depth):
            each = max(1, HISTOGRAM_BYTES // (max(map(len, features)) * store.manifest["max_bin"] * 16))
            found: list = []
            for a in range(0, len(active), each):
                nodes: dict[int, list[int]] = {}
                for c, node in active[a : a + each]:
                    nodes.setdefault(c, []).append(node)
                splits, seen = self._level(store, rows, since, trees, nodes, features, number, depth == 0 and a == 0)
                found += splits
                loss = seen if depth == 0 and a == 0 else loss
            best: dict[tuple[int, int], tuple] = {}
            for r in sorted(found, key=lambda r: (r["cls"], r["node"], -r["gain"], r["feature"], r["cut"])):
                best.setdefault((r["cls"], r["node"]), r)
            active = []
            for (c, node), r in best.items():
                tree = trees[c]
                if depth == 0:
                    tree.leaf[node] = self._leaf(r["g"], r["h"])
                if r["feature"] < 0:
                    continue
                tree.feature[node], tree.cut[node], tree.value[node] = r["feature"], r["cut"], store.cuts[r["feature"]][r["cut"]]
                for child, g, h in ((2 * node, r["left_g"], r["left_h"]), (2 * node + 1, r["g"] - r["left_g"], r["h"] - r["left_h"])):
                    tree.leaf[child] = self._leaf(g, h)
                    if h >= 2 * o.least_hessian * SCALE:
                        active.append((c, child))
            if not active:
                break
        return trees, loss

    def _leaf(self, g: int, h: int) -> float:
        pull = np.sign(g) * max(abs(g / SCALE) - self.options.lasso, 0.0)
        return float(-self.options.rate * pull / (h / SCALE + self.options.ridge))

    def _level(self, store: Store, rows: DataFrame, since: list[list[Tree]], trees: list[Tree], nodes: dict[int, list[int]], features: list[list[int]], number: int, with_loss: bool) -> tuple[list, float]:
        """Best splits of the nodes by slice of features, and the validation loss if asked for."""
        o, bins, width = self.options, store.manifest["max_bin"], len(store.cuts)
        held = store.spark.sparkContext.broadcast((since, trees, nodes, features))

        def sums(batches):
            since, trees, nodes, features = held.value
            total = {c: np.zeros((len(features[c]), len(own) * bins, 2)) for c, own in nodes.items()}
            local = {c: np.full(2 << o.depth, -1) for c in nodes}
            for c, own in nodes.items():
                local[c][own] = np.arange(len(own))
            loss = np.zeros(2)
            for validation, row, label, weight, x, m in _blocks(batches, width):
                if validation:
                    if with_loss:
                        own = softmax(margins(x, since, m))[np.arange(len(x)), label]
                        loss += np.rint(np.c_[-np.log(np.maximum(own, 1e-15)), np.ones(len(own))] * weight[:, None] * SCALE).sum(axis=0)
                    continue
                on = np.flatnonzero(drawn(row, number, o.seed, o.rows))
                x = x[on]
                g, h = gradients(softmax(margins(x, since, m[on])), label[on], weight[on])
                x = np.asfortranarray(x)
                for c in nodes:
                    at = local[c][trees[c].places(x)]
                    live = at >= 0
                    base, gc, hc = at[live] * bins, g[live, c], h[live, c]
                    for k, f in enumerate(features[c]):
                        cell = base + x[live, f]
                        total[c][k, :, 0] += np.bincount(cell, gc, total[c].shape[1])
                        total[c][k, :, 1] += np.bincount(cell, hc, total[c].shape[1])
            out = [(-1, 0, 0, loss.astype("<i8").tobytes())]
            for c, own in nodes.items():
                each = total[c].reshape(len(features[c]), len(own), bins, 2)
                for k, node in enumerate(own):
                    if each[0, k, :, 1].any():
                        out += [(c, node, s // SLICE, each[s : s + SLICE, k].astype("<i8").tobytes()) for s in range(0, len(features[c]), SLICE)]
            for a in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out[a : a + 64]), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["cls", "node", "slice", "sums"])

        def splits(batches):
            features = held.value[3]
            for (c, node, part), total in _added(batches):
                if c < 0:
                    yield _row(c, 0, -1, 0, 0.0, 0, 0, int(total[0]), int(total[1]))
                    continue
                each = total.reshape(-1, bins, 2)
                g, h = (int(v) for v in each[0].sum(axis=0))
                found = best_cut(each, o)
                yield _row(c, node, -1, 0, 0.0, 0, 0, g, h) if found is None else _row(c, node, features[c][part * SLICE + found[0]], found[1], found[2], found[3], found[4], g, h)

        keys = ["cls", "node", "slice"]
        seen = rows if with_loss else rows.filter("NOT validation")
        found = seen.mapInArrow(sums, SUMS).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(splits, BEST).collect()  # a row a node and slice
        held.destroy()
        loss = next((r["g"] / r["h"] if r["h"] else float("nan") for r in found if r["cls"] < 0), float("nan"))
        return [r for r in found if r["cls"] >= 0], loss

    # Use.
    def score(self, samples: DataFrame, features: str = "features") -> DataFrame:
        """Samples with the probabilities ``down``, ``flat`` and ``up``."""
        held = samples.sparkSession.sparkContext.broadcast(self.rounds)

        def run(batches):
            for batch in batches:
                p = softmax(margins(matrix(batch.column(batch.schema.get_field_index("__x"))), held.value, by_value=True))
                rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "__x"]
                yield pa.RecordBatch.from_arrays([*(c for _, c in rest), *(pa.array(p[:, k]) for k in range(CLASSES))], names=[*(n for n, _ in rest), "down", "flat", "up"])

        schema = samples.select("*", *(F.lit(0.0).alias(n) for n in ("down", "flat", "up"))).schema
        return samples.withColumn("__x", F.transform(features, lambda v: v.cast("float"))).mapInArrow(run, schema)

    def importances(self, names: list[str], most: int = 20) -> list[tuple[str, float]]:
        """Features by how many splits they make."""
        counts = np.zeros(len(names))
        for trees in self.rounds:
            for tree in trees:
                np.add.at(counts, tree.feature[tree.feature >= 0], 1)
        return sorted(zip(names, (counts / max(1, counts.sum())).tolist()), key=lambda x: -x[1])[:most]

    def save(self, spark: SparkSession, path: str) -> None:
        write_rounds(spark, path, self.rounds, self.losses, asdict(self.options))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Booster:
        rounds, losses = read_rounds(spark, path)
        options = json.loads(spark.read.text(f"{path}/losses").first()["value"])["options"]
        return cls(replace(Options(), **options), rounds, losses)


def _blocks(batches, width: int) -> Iterator[tuple]:
    """(whether they are validation rows, row, label, weight, bins, margins) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            row, label, weight, bins, margin = (np.frombuffer(c[k].as_buffer(), kind) for c, kind in zip(batch.columns[1:], ("<i8", "<i4", "<f8", np.uint8, "<f8")))
            yield batch.column(0)[k].as_py(), row, label, weight, bins.reshape(-1, width), margin.reshape(-1, CLASSES)


def _row(*values) -> pa.RecordBatch:
    names = [c.split()[0] for c in BEST.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in BEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


def _added(batches) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """Sums of each key from rows sorted by key, one row at a time."""
    key, total = None, None
    for batch in batches:
        for at in range(batch.num_rows):
            now, sums = tuple(batch.column(k)[at].as_py() for k in range(3)), np.frombuffer(batch.column(3)[at].as_py(), "<i8")
            if now == key:
                total += sums
                continue
            if key is not None:
                yield key, total
            key, total = now, sums.copy()
    if key is not None:
        yield key, total


def write_rounds(spark: SparkSession, path: str, rounds: list[list[Tree]], losses: list[float], options: dict | None = None) -> None:
    """All trees as one table (they fit in the driver, which made them); the losses come last and mark it whole."""
    rows = [(k, c, t.feature.tolist(), t.cut.tolist(), t.value.tolist(), t.leaf.tolist()) for k, trees in enumerate(rounds) for c, t in enumerate(trees)]
    spark.createDataFrame(rows, "round int, cls int, feature array<int>, cut array<int>, value array<float>, leaf array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    spark.createDataFrame([(json.dumps({"losses": losses, "options": options}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/losses")


def read_rounds(spark: SparkSession, path: str) -> tuple[list[list[Tree]], list[float]]:
    found = {(r["round"], r["cls"]): Tree(np.array(r["feature"], np.int32), np.array(r["cut"], np.int32), np.array(r["value"], np.float32), np.array(r["leaf"])) for r in spark.read.parquet(f"{path}/trees").collect()}
    rounds = [[found[k, c] for c in range(CLASSES)] for k in range(len(found) // CLASSES)]
    return rounds, json.loads(spark.read.text(f"{path}/losses").first()["value"])["losses"]


def saved_rounds(spark: SparkSession, state: str) -> list[int]:
    """Rounds after which a whole state was saved, in order."""
    top = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
    whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{n}/losses/_SUCCESS"))
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("rounds=") and whole(n))
