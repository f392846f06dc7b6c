"""A store of training samples with their features in quantile bins: a byte for each feature, written once and reused.

A folder with ``cuts`` (feature, cuts), ``rows`` (row, validation, label, price_diff, bins) and ``manifest``. A feature's cuts are
values at even ranks of the training rows, by one mergeable sketch a feature; a value's bin is how many cuts lie below it, so
``value <= cuts[b]`` and ``bin <= b`` say the same. Missing values fall in bin 0. Validation rows are binned by the same cuts.

The manifest says what the store was made from: a fingerprint of the input files (names, sizes, times) and the options. A
store whose fingerprint agrees is reused without reading the inputs.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.sources.sinks import is_complete

#: Bins of a feature, at most (a bin is a byte).
MAX_BIN = 256
#: A cut's rank may be off by one in this many rows, for each bin.
ACCURACY = 20
ROWS = "row long, validation boolean, label int, price_diff double, bins binary"


def matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    """A list column, all lists of one length, as a matrix; missing values are NaN."""
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False) if not flat.null_count else flat.to_pandas().to_numpy(float)
    return np.asarray(values, dtype).reshape(len(column), -1)


def byte_matrix(column: pa.Array, dtype) -> np.ndarray:
    """A binary column, all values of one size, as a matrix. No value becomes a Python object."""
    offsets = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset)
    return np.frombuffer(memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]], dtype).reshape(len(column), -1)


def binary_rows(values: np.ndarray) -> pa.Array:
    """Each row of a matrix as a byte string."""
    raw = np.ascontiguousarray(values)
    size = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1, dtype=np.int64) * size).astype("<i4").tobytes()), pa.py_buffer(raw.tobytes())])


def bins_of(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many of its feature's cuts lie below each value."""
    out = np.zeros(values.shape, np.uint8)
    for f, own in enumerate(cuts):
        column = values[:, f]
        out[:, f] = np.where(np.isnan(column), 0, np.searchsorted(own, column, side="left"))
    return out


def quantile_cuts(samples: DataFrame, features: str, width: int, max_bin: int = MAX_BIN) -> list[np.ndarray]:
    """Each feature's distinct values at ranks k / max_bin. One aggregation: sketches are merged, values aren't shuffled."""
    at = F.array(*(F.lit(k / max_bin) for k in range(1, max_bin)))
    value = lambda f: F.get(features, F.lit(f)).cast("double")
    row = samples.agg(*(F.percentile_approx(F.when(~F.isnan(value(f)), value(f)), at, F.lit(ACCURACY * max_bin)).alias(f"c{f}") for f in range(width))).first()
    return [np.unique(np.array(row[f"c{f}"] or [], np.float32)) for f in range(width)]


def folder_fingerprint(spark: SparkSession, folder: str, options: dict) -> str:
    """A hash of a folder's files (names, sizes, times) and the options."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, found = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps([sorted(found), options], sort_keys=True).encode()).hexdigest()


class Store:
    """A written store, by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
        cuts = {r["feature"]: np.array(r["cuts"], np.float32) for r in spark.read.parquet(f"{path}/cuts").collect()}  # a row a feature
        self.cuts = [cuts[f] for f in range(len(cuts))]
        self.rows = spark.read.schema(ROWS).parquet(f"{path}/rows")

    def counts(self, validation: bool = False) -> list[int]:
        """Rows of each label."""
        return self.manifest["counts"]["validation" if validation else "train"]


def find(spark: SparkSession, path: str, fingerprint: str) -> Store | None:
    """The store at ``path`` if it is whole and was made from inputs of this fingerprint."""
    if not is_complete(spark, f"{path}/manifest"):
        return None
    store = Store(spark, path)
    return store if store.manifest["fingerprint"] == fingerprint else None


def write(samples: DataFrame, path: str, fingerprint: str = "", features: str = "features", validation: str = "validation", max_bin: int = MAX_BIN) -> Store:
    """Bin samples (features, label, price_diff, validation) and write the store; the manifest comes last."""
    spark = samples.sparkSession
    if not 2 <= max_bin <= MAX_BIN:
        raise ValueError(f"bins of a feature: 2 to {MAX_BIN}")
    known = samples.filter(F.col("label").isin(0, 1, 2))
    width = known.agg(F.max(F.size(features))).first()[0] or 0
    if not width:
        raise ValueError("no samples with labels 0, 1, 2")
    cuts = quantile_cuts(known.filter(~F.col(validation)), features, width, max_bin)
    spark.createDataFrame([(f, [float(x) for x in c]) for f, c in enumerate(cuts)], "feature int, cuts array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cuts")
    held = spark.sparkContext.broadcast(cuts)

    def run(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in ("row", "validation", "label", "price_diff")), binary_rows(bins_of(matrix(columns["x"]), held.value))], names=["row", "validation", "label", "price_diff", "bins"])

    source = known.select(F.monotonically_increasing_id().alias("row"), F.col(validation).alias("validation"), F.col("label").cast("int").alias("label"), F.coalesce(F.col("price_diff").cast("double"), F.lit(0.0)).alias("price_diff"), F.transform(features, lambda v: v.cast("float")).alias("x"))
    source.mapInArrow(run, ROWS).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    seen = {(r["validation"], r["label"]): (r["n"], r["move"]) for r in rows.groupBy("validation", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("price_diff")).alias("move")).collect()}
    counts = {name: [seen.get((flag, k), (0, 0.0))[0] for k in range(3)] for name, flag in (("train", False), ("validation", True))}
    move = sum(seen.get((False, k), (0, 0.0))[1] for k in range(3)) / max(1, sum(counts["train"]))
    manifest = {"fingerprint": fingerprint, "features": width, "max_bin": max_bin, "counts": counts, "mean_move": move}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return Store(spark, path)
