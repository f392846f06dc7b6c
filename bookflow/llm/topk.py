"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are rounded down to integers (components times ``scale``). They are ordered by the nearest of a few centroids, so
that neighbours in the order are alike, and cut into groups of a few thousand and blocks of a few hundred. A block, and a
group, keeps for each dimension the largest and least component; for a query the sum over dimensions of the larger product
bounds every score inside.

1. A query's own group is searched first: its k-th score is a floor.
2. Batches of queries meet the bounds of all groups (two vectors a group, in slabs); only queries whose bound reaches their
   floor are sent to a group, with their floor.
3. There a query visits blocks in falling order of bounds, scores a block by a product with its forward index (its
   matrix), and stops when the bound falls below the k-th best score so far.

The centroids come from a bounded sample and change the speed alone: every vector is in exactly one block and every pair of
query and block is scored or bounded.

Scores are exact integers: products run in doubles while no sum can reach 2**53, in 64-bit integers while none can reach
2**63, else in Python's integers; a score beyond 64 bits is given as the nearest 64-bit integer.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without an id;
every row but the query's own is a candidate, so rows that repeat an id are candidates each, and queries each (then an id
has several lists); vectors that are shorter than the longest count as filled with zeros; ties go to smaller ids; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from bookflow.llm.common import materialize, remove

#: Vectors of a group and of a block; centroids; vectors that the centroids are fitted on, at most.
GROUP, BLOCK, CENTROIDS, SAMPLE = 4096, 256, 64, 4096
#: Groups whose queries make a batch; groups whose bounds make a slab.
BATCH_GROUPS, SLAB = 32, 1024
NONE = np.iinfo(np.int64).min
PACKED = "grp long, ids binary, row_ids binary, matrix binary, bounds binary, asks binary, queries binary, kth binary"
SENT = "grp long, asks binary, queries binary, kth binary"
FOUND = "query_row long, query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, row, x): floor(scale * component) of every sound vector, with a number for each row."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null").filter(F.forall("v", finite))
    return sound.select("id", F.monotonically_increasing_id().alias("row"), F.transform("v", lambda v: F.floor(v * scale)).alias("x"))


def centroids(sample: np.ndarray, count: int = CENTROIDS, steps: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows of the sample."""
    if not len(sample):
        return np.zeros((1, 1))
    c = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)].astype(float)
    for _ in range(steps):
        near = nearest(sample, c)
        for k in range(len(c)):
            if (near == k).any():
                c[k] = sample[near == k].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * x.astype(float) @ c.T, axis=1)


def dense(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for k, v in enumerate(lists):
        out[k, : len(v)] = v
    return out


def to_bytes(matrix: np.ndarray) -> bytes:
    """Integers in 16 bits where they fit, else 64; the first byte says which."""
    small = not matrix.size or (matrix.min() >= -(1 << 15) and matrix.max() < 1 << 15)
    return (b"s" if small else b"l") + matrix.astype("<i2" if small else "<i8").tobytes()


def from_bytes(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if raw[:1] == b"s" else "<i8", offset=1).reshape(-1, width).astype(np.int64)


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products q @ x.T, exact to 64 bits."""
    largest = [max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0 for m in (q, x)]
    reach = largest[0] * largest[1] * q.shape[1]
    if reach < 2**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    if reach < 2**63:
        return q @ x.T
    whole = np.array(q.tolist(), object).reshape(q.shape) @ np.array(x.tolist(), object).reshape(x.shape).T
    return np.clip(whole, np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max).astype(np.int64)


def bounds_of(matrix: np.ndarray) -> np.ndarray:
    """The largest, then the least component in each dimension."""
    return np.concatenate([matrix.max(axis=0), matrix.min(axis=0)])


def bounds(queries: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """No score of a query with a vector of a part is larger: (queries, parts)."""
    return product(np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1), parts)


class Best:
    """The k best rows of each query: more score first, then the smaller id."""

    def __init__(self, query_rows: np.ndarray, k: int, kth: np.ndarray | None = None):
        self.query_rows, self.k = query_rows, k
        self.score = np.full((len(query_rows), k), NONE, np.int64)
        self.id, self.row = (np.full((len(query_rows), k), np.iinfo(np.int64).max) for _ in range(2))
        self.floor = np.full(len(query_rows), NONE, np.int64) if kth is None else kth

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, at: np.ndarray, ids: np.ndarray, row_ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.where(row_ids[None, :] == self.query_rows[at, None], NONE, scores)
        score = np.concatenate([self.score[at], scores], axis=1)
        every, rows = (np.concatenate([old[at], np.broadcast_to(new, scores.shape)], axis=1) for old, new in ((self.id, ids), (self.row, row_ids)))
        order = np.lexsort((every, ~score), axis=1)[:, : self.k]
        self.score[at], self.id[at], self.row[at] = (np.take_along_axis(a, order, axis=1) for a in (score, every, rows))

    def found(self, query_ids: np.ndarray) -> dict[str, np.ndarray]:
        q, r = np.nonzero((self.score > NONE) & (self.score >= self.floor[:, None]))
        return {"query_row": self.query_rows[q], "query_id": query_ids[q], "vec_id": self.id[q, r], "score": self.score[q, r]}


def visit(best: Best, queries: np.ndarray, ids: np.ndarray, row_ids: np.ndarray, matrix: np.ndarray) -> None:
    """Score the blocks of one group for a batch of queries, each in the order of its bounds."""
    bound = bounds(queries, np.array([bounds_of(matrix[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]))
    order = np.argsort(~bound, axis=1, kind="stable")
    every = np.arange(len(queries))
    for turn in range(bound.shape[1]):
        block = order[:, turn]
        live = bound[every, block] >= best.kth()
        if not live.any():
            return
        for b in np.unique(block[live]):
            at = np.flatnonzero(live & (block == b))
            part = slice(b * BLOCK, (b + 1) * BLOCK)
            best.add(at, ids[part], row_ids[part], product(queries[at], matrix[part]))


def packed_row(grp: int, found: pd.DataFrame, width: int, every: int, k: int) -> list:
    """One group's vectors, bounds and queries; the queries' k-th scores inside the group."""
    found = found.sort_values(["cell", "id", "row"])
    ids, rows, matrix = found["id"].to_numpy(np.int64), found["row"].to_numpy(np.int64), dense(found["x"].tolist(), width)
    asks = ids % every == 0
    best = Best(rows[asks], k)
    if asks.any():
        visit(best, matrix[asks], ids, rows, matrix)
    return [grp, ids.tobytes(), rows.tobytes(), to_bytes(matrix), to_bytes(bounds_of(matrix)), np.c_[rows[asks], ids[asks]].tobytes(), to_bytes(matrix[asks]), best.kth().tobytes()]


def joined(asked: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows and ids, vectors, floors) of the queries of several groups."""
    asks = np.frombuffer(b"".join(q["asks"] for q in asked), np.int64).reshape(-1, 2)
    return asks, np.concatenate([from_bytes(q["queries"], width) for q in asked]), np.frombuffer(b"".join(q["kth"] for q in asked), np.int64)


def sent_to_groups(packed: DataFrame, width: int, groups: int) -> DataFrame:
    """(grp, asks, queries, kth): a batch's queries for each group whose bound reaches their floor."""
    batches = packed.filter(F.length("asks") > 0).groupBy(F.floor(F.col("grp") / BATCH_GROUPS)).agg(F.collect_list(F.struct("asks", "queries", "kth")).alias("asked"))
    slabs = packed.groupBy(F.floor(F.col("grp") / SLAB).alias("slab")).agg(F.collect_list(F.struct("grp", "bounds")).alias("parts"))
    every_slab = F.sequence(F.lit(0).cast("long"), F.lit(max(0, groups - 1) // SLAB).cast("long"))

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                asks, queries, kth = joined(row["asked"], width)
                parts = np.concatenate([from_bytes(p["bounds"], 2 * width) for p in row["parts"]])
                live = bounds(queries, parts) >= kth[:, None]
                for p in np.flatnonzero(live.any(axis=0)):
                    on = live[:, p]
                    yield pa.RecordBatch.from_arrays([pa.array([row["parts"][p]["grp"]], pa.int64()), *(pa.array([x], pa.binary()) for x in (asks[on].tobytes(), to_bytes(queries[on]), kth[on].tobytes()))], names=[c.split()[0] for c in SENT.split(", ")])

    return batches.select("asked", F.explode(every_slab).alias("slab")).join(slabs, "slab").select("asked", "parts").mapInArrow(run, SENT)


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    sound, sound_path = materialize(integers(vectors, scale, id_col, vector_col), "vectors")
    width = max(1, sound.agg(F.max(F.size("x"))).first()[0] or 1)
    sample = dense([r["x"] for r in sound.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE).collect()], width)
    held = spark.sparkContext.broadcast(centroids(sample))

    def cell(x: pd.Series) -> pd.Series:
        return pd.Series(nearest(dense(x.tolist(), held.value.shape[1]), held.value), dtype="int32")

    placed, placed_path = materialize(sound.withColumn("cell", F.pandas_udf(cell, "int")("x")), "vectors")
    counts = dict(placed.groupBy("cell").count().collect())  # a row for each centroid
    offset, groups, tiles, room = {}, 0, {}, 0
    for c in sorted(counts):  # small cells share a group, large ones are dealt to several
        if counts[c] > room:
            offset[c], tiles[c] = groups, -(-counts[c] // GROUP)
            groups += tiles[c]
            room = tiles[c] * GROUP - counts[c]
        else:
            offset[c], tiles[c], room = groups - 1, 1, room - counts[c]
    lookup = lambda d: F.create_map(*(F.lit(x) for pair in (d or {0: 1}).items() for x in pair))[F.col("cell")]
    grouped = placed.withColumn("grp", (lookup(offset) + F.pmod(F.xxhash64("id", "row"), lookup(tiles))).cast("long"))

    def pack(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([packed_row(key[0], found, width, every, k)], columns=[c.split()[0] for c in PACKED.split(", ")])

    packed, _ = materialize(grouped.select("id", "row", "cell", "x", "grp").groupBy("grp").applyInPandas(pack, PACKED), "vector-groups")
    remove(spark, sound_path)
    remove(spark, placed_path)
    # The k-th score of the own group is a floor only: that group is visited again, so that its own best are reported.
    tiles_of = sent_to_groups(packed, width, groups).join(packed.select("grp", "ids", "row_ids", "matrix"), "grp")

    def run(batches):
        schema = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                asks, queries, kth = joined([row], width)
                best = Best(asks[:, 0], k, kth)
                visit(best, queries, *(np.frombuffer(row[c], np.int64) for c in ("ids", "row_ids")), from_bytes(row["matrix"], width))
                yield pa.RecordBatch.from_pydict(best.found(asks[:, 1]), schema=schema)

    found = tiles_of.select("asks", "queries", "kth", "ids", "row_ids", "matrix").mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
