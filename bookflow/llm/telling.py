"""Sparse text features that tell two labels apart beyond chance, and matrices of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.bpe import rows_of
from bookflow.llm.common import materialize, remove

#: Features whose counts a task holds before it passes them on.
HELD_FEATURES = 200_000


def telling(sample: DataFrame, features_of: Callable[[str], set[str]], either: bool = False, least: int = 4, level: float = 0.05) -> list[tuple[str, int, int]]:
    """(feature, rows of label 0, rows of label 1) of every feature that prefers label 1 (or ``either`` label) beyond chance.

    A likelihood-ratio test (G) of the rows that hold the feature, its level divided by the number of candidates; the
    strongest first. All features that pass are returned: their number is bounded by the sample's texts alone.
    """

    def counted(seen):
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], names=["feature", "n0", "n1"])

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in (part for whole in batches for part in rows_of(whole)):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for feature in features_of(text):
                    seen.setdefault(feature, [0, 0])[label] += 1
            if len(seen) > HELD_FEATURES:
                yield counted(seen)
                seen = {}
        yield counted(seen)

    sizes = dict(sample.groupBy("label").count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return []
    counts = sample.select("label", "text").mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= least)
    n, share = F.col("n0") + F.col("n1"), n1 / (n0 + n1)
    term = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)
    g = 2 * (term(F.col("n1"), n * share) + term(F.col("n0"), n * (1 - share)))
    wanted = F.lit(True) if either else (F.col("n1") > n * share) & (2 * F.col("n1") >= n)
    tested, held = materialize(counts.withColumn("g", g), "feature-counts")
    critical = 2 * np.log(max(2, tested.count()) / level)
    found = [tuple(r) for r in tested.filter((F.col("g") >= float(critical)) & wanted).orderBy(F.desc("g"), "feature").select("feature", "n0", "n1").collect()]
    remove(sample.sparkSession, held)
    return found


class Sparse:
    """A matrix by its entries, for products with vectors only."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    @staticmethod
    def of_rows(rows: Iterable[tuple[Iterable[int], Iterable[float]]], width: int) -> Sparse:
        """From each row's (columns, values)."""
        rows = [(np.asarray(at, np.int64), np.asarray(values, float)) for at, values in rows]
        sizes = [len(at) for at, _ in rows]
        column, value = (np.concatenate([np.empty(0, kind), *(r[k] for r in rows)]) for k, kind in ((0, np.int64), (1, float)))
        return Sparse(np.repeat(np.arange(len(rows)), sizes), column, value, (len(rows), width))

    @staticmethod
    def of(dense: np.ndarray) -> Sparse:
        row, column = np.nonzero(dense)
        return Sparse(row, column, dense[row, column], dense.shape)

    def dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * v[self.column], self.shape[0])

    def dot_rows(self, v: np.ndarray) -> np.ndarray:
        """The product of the transpose with ``v``."""
        return np.bincount(self.column, self.value * v[self.row], self.shape[1])


def solve(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, easy: Callable[[np.ndarray], np.ndarray], steps: int = 60, tolerance: float = 1e-4) -> np.ndarray:
    """Conjugate gradients; ``easy`` solves an approximation of the system."""
    x, r = np.zeros_like(b), b.copy()
    z = easy(r)
    p, rz = z.copy(), r @ z
    end = tolerance**2 * max(rz, 1e-300)
    for _ in range(steps):
        if rz <= end:
            break
        q = apply(p)
        a = rz / (p @ q)
        x += a * p
        r -= a * q
        z = easy(r)
        new = r @ z
        p = z + new / rz * p
        rz = new
    return x
