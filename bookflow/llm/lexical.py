"""Exact ranked lexical search over a two-level quantised index.

Terms are runs of ASCII letters, digits and all characters beyond ASCII; A-Z count as a-z. With N documents that hold a term,
L terms in all, n terms of a document, df documents of a term and tf occurrences in a document, in integers:

    m = 25 + 75 * n * N div L        saturation = 1000000000 * tf div (1000 * tf + 8 * m)
    weight = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))        score = sum of weight * saturation over a query's terms

The index (a folder in shared storage) has rows of a few thousand documents each, made where documents are read, so texts are
never shuffled. Both levels hold a block's postings, term by term:

* level 1: ``terms``, ``starts``, ``docs`` and ``impacts``: the saturation in steps of ``STEP``, rounded up to a byte; ``tops``:
  each term's largest impact in the block;
* level 2: ``tf``, ``lens`` and ``ids``, from which scores are exact.

An impact times STEP is at least the saturation, and less one step at most that, so sums over a query's terms bound a score
from above and below. A search runs in two passes over the blocks:

1. level 1 alone is read: a task keeps each query's k largest lower bounds; over all tasks the k-th is the query's floor;
2. a block whose tops can't reach the floor is passed over; every document whose upper bound reaches it is scored from
   level 2, and a task keeps the k best.

Queries are taken in batches of at most ``BATCH_BYTES`` of text, by a hash of their ids, so what is sent to tasks is bounded;
a task returns k rows a query.

Defined results: a null text has no terms; documents that repeat an id, or have none, count and rank as documents each (no id
comes first among equals); of queries that repeat an id the greatest text counts; a query without terms has no rows, nor has
one whose terms no document holds; ties go to smaller ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from bookflow.llm.bpe import rows_of
from bookflow.llm.common import materialize, remove, scratch

#: Documents and postings of a block, at most (one document may have more postings).
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 500_000
#: Blocks of a row group, at most: Spark's writer holds a row group, and its reader takes one as a batch, whatever its bytes.
GROUP = {"parquet.block.row.count.limit": 2}
#: A step of the saturation, which is below a million: 255 steps reach it.
STEP = -(-1_000_000 // 255)
#: Text of a batch of queries.
BATCH_BYTES = 8 << 20
#: Stands for no id: smaller than any.
NO_ID = -(2**63)
# What ends a term becomes a space, A-Z become a-z; bytes of characters beyond ASCII stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
EXACT = "terms array<binary>, starts binary, docs binary, tf binary, lens binary, ids binary"
INDEX = "terms array<binary>, starts binary, docs binary, impacts binary, tops binary, tf binary, lens binary, ids binary"
LEVEL_1 = ("terms", "starts", "docs", "impacts", "tops")


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


def narrow(values: np.ndarray) -> bytes:
    """Counts in 16 bits where they fit, else in 32 or 64; the first byte says which."""
    top = int(values.max()) if len(values) else 0
    code, kind = (b"s", "<u2") if top < 1 << 16 else (b"i", "<u4") if top < 1 << 32 else (b"l", "<i8")
    return code + values.astype(kind).tobytes()


def wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {b"s": "<u2", b"i": "<u4", b"l": "<i8"}[raw[:1]], offset=1).astype(np.int64)


class Builder:
    """Postings of a block in the making."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.term, self.tf, self.distinct, self.lens, self.ids = array("q"), array("q"), array("q"), array("q"), array("q")

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        found = Counter(terms)
        number = self.number
        self.term.extend([number.setdefault(t, len(number)) for t in found])
        self.tf.extend(found.values())
        self.distinct.append(len(found))
        self.lens.append(len(terms))
        self.ids.append(NO_ID if doc_id is None else doc_id)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or len(self.term) >= BLOCK_POSTINGS

    def row(self) -> list:
        term, docs = np.array(self.term, np.int64), np.repeat(np.arange(len(self.ids)), np.array(self.distinct, np.int64))
        order = np.argsort(term, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(term, minlength=len(self.number)))]
        return [list(self.number), narrow(starts), narrow(docs[order]), narrow(np.array(self.tf, np.int64)[order]), narrow(np.array(self.lens, np.int64)), np.array(self.ids, "<i8").tobytes()]


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.list_(pa.binary()) if c.endswith("<binary>") else pa.binary()) for c in ddl.split(", ")])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """A block's columns by name, bytes as they are, terms as an Arrow array."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(k)[at].values if name == "terms" else batch.column(k)[at].as_py() for k, name in enumerate(batch.schema.names)}


def saturation(tf: np.ndarray, lens: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The exact saturation of postings from their tf and their documents' n."""
    m = 25 + 75 * lens * documents // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of all documents."""
    spark = docs.sparkSession

    def exact(batches):
        schema, held = _arrow(EXACT), Builder()
        for batch in (small for whole in batches for small in rows_of(whole)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.add(doc_id, terms_of(text))
                if held.full():
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(held.row(), schema)], schema=schema)
                    held = Builder()
        if held.ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(held.row(), schema)], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    raw, folder = materialize(source.mapInArrow(exact, EXACT), "postings", **GROUP)

    def sizes(batches):
        seen = [wide(b["lens"]) for b in _blocks(batches)]
        yield pa.RecordBatch.from_pydict({"n": [int(sum((x > 0).sum() for x in seen))], "terms": [int(sum(x.sum() for x in seen))]}, schema=pa.schema([("n", pa.int64()), ("terms", pa.int64())]))

    documents, total = raw.select("lens").mapInArrow(sizes, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    documents, total = documents or 0, total or 0
    spark.createDataFrame([(documents, total)], "documents long, terms long").coalesce(1).write.parquet(f"{path}/sizes")

    def quantised(batches):
        schema = _arrow(INDEX)
        for b in _blocks(batches):
            starts, at = wide(b["starts"]), wide(b["docs"])
            impacts = -(-saturation(wide(b["tf"]), wide(b["lens"])[at], documents, max(1, total)) // STEP)
            tops = np.maximum.reduceat(impacts, starts[:-1]) if len(impacts) else impacts
            b |= {"impacts": impacts.astype(np.uint8).tobytes(), "tops": tops.astype(np.uint8).tobytes()}
            yield pa.RecordBatch.from_arrays([pa.array([b[f.name].to_pylist()] if f.name == "terms" else [b[f.name]], f.type) for f in schema], schema=schema)

    raw.mapInArrow(quantised, INDEX).write.option("compression", "zstd").options(**GROUP).parquet(f"{path}/blocks")
    remove(spark, folder)


class Queries:
    """A batch of queries: distinct terms, and each query's terms by number with how often it has them."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        counts = [Counter(terms_of(text)) for _, text in rows]
        self.ids = [i for i, _ in rows]
        self.terms = sorted(set().union(*counts))
        number = {t: k for k, t in enumerate(self.terms)}
        self.own = [np.array([number[t] for t in c], np.int64) for c in counts]
        self.times = [np.array(list(c.values()), np.int64) for c in counts]
        self.weight = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: dict[int, int], documents: int) -> None:
        for k, n in df.items():
            self.weight[k] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))

    def places(self, block: dict) -> np.ndarray:
        """Each term's number in the block, -1 where it hasn't the term."""
        return pc.index_in(pa.array(self.terms, pa.binary()), value_set=block["terms"]).fill_null(-1).to_numpy().astype(np.int64)

    def bounds(self, block: dict, reach: list[int | None]) -> Iterator[tuple[int, list[tuple[int, slice]], np.ndarray, np.ndarray, np.ndarray]]:
        """(query, its (weight, postings) here, documents, upper and lower bounds in steps) for each query that can reach ``reach``."""
        places, starts, tops = self.places(block), wide(block["starts"]), np.frombuffer(block["tops"], np.uint8).astype(np.int64)
        docs, impacts = wide(block["docs"]), np.frombuffer(block["impacts"], np.uint8)
        for q, (own, times) in enumerate(zip(self.own, self.times)):
            at, weight = places[own], self.weight[own] * times
            live = (at >= 0) & (weight > 0)
            at, weight = at[live], weight[live]
            if not len(at) or reach[q] is not None and int((weight * tops[at]).sum()) < reach[q]:
                continue
            parts = [slice(a, b) for a, b in zip(starts[at].tolist(), starts[at + 1].tolist())]
            each = np.repeat(weight, starts[at + 1] - starts[at])
            here = np.concatenate([docs[p] for p in parts])
            upper = np.bincount(here, each * np.concatenate([impacts[p] for p in parts]))
            less = np.bincount(here, each)
            found = np.flatnonzero(less)
            yield q, list(zip(weight.tolist(), parts)), found, upper[found], upper[found] - less[found]


def _frequencies(index: DataFrame, queries: Queries) -> dict[int, int]:
    """Documents that hold each term of a batch: a row for each term and task is summed."""
    held = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        total = np.zeros(len(held.value.terms), np.int64)
        for b in _blocks(batches):
            places, sizes = held.value.places(b), np.diff(wide(b["starts"]))
            on = places >= 0
            total[on] += sizes[places[on]]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    return dict(index.select("terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())


def _floors(index: DataFrame, queries: Queries, k: int) -> list[int | None]:
    """Each query's k-th largest lower bound over all documents, None where fewer hold a term of it."""
    held = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        best: list[np.ndarray] = [np.empty(0)] * len(held.value.own)
        reach: list[int | None] = [None] * len(best)
        for b in _blocks(batches):
            for q, _, _, _, lower in held.value.bounds(b, reach):
                both = np.concatenate([best[q], lower])
                best[q] = np.partition(both, len(both) - k)[len(both) - k :] if len(both) > k else both
                reach[q] = int(best[q].min()) if len(best[q]) == k else None
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), [len(x) for x in best]), pa.int64()), pa.array(np.concatenate([np.empty(0), *best]).astype(np.int64))], names=["query", "lower"])

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))
    found = index.select(*LEVEL_1).mapInArrow(run, "query long, lower long").withColumn("place", rank).filter(F.col("place") <= k).groupBy("query").agg(F.min("lower"), F.count(F.lit(1))).collect()
    full = {q: lower for q, lower, n in found if n == k}
    return [full.get(q) for q in range(len(queries.own))]


def _best(index: DataFrame, queries: Queries, floors: list[int | None], k: int, documents: int, total: int) -> DataFrame:
    """(query, doc_id, score): each task's k best of every query, scored exactly."""
    held = index.sparkSession.sparkContext.broadcast((queries, floors))

    def run(batches):
        asked, floor = held.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in floor]  # scores and ids, in order
        for b in _blocks(batches):
            reach = [f if len(s) < k else max(s[-1] // STEP, -1 if f is None else f) for f, (s, _) in zip(floor, best)]
            docs, tf, lens, ids = wide(b["docs"]), wide(b["tf"]), wide(b["lens"]), np.frombuffer(b["ids"], "<i8")
            for q, parts, found, upper, _ in asked.bounds(b, reach):
                if reach[q] is not None:
                    found = found[upper >= reach[q]]
                if not len(found):
                    continue
                place = np.full(len(ids), -1)
                place[found] = np.arange(len(found))
                score = np.zeros(len(found), np.int64)
                for weight, part in parts:
                    at = docs[part]
                    on = place[at] >= 0
                    score[place[at[on]]] += weight * saturation(tf[part][on], lens[at[on]], documents, total)  # a document is there once
                score, names = np.r_[best[q][0], score], np.r_[best[q][1], ids[found]]
                order = np.lexsort((names, -score))[:k]
                best[q] = score[order], names[order]
        on = [(q, i, s) for q, (scores, names) in enumerate(best) for s, i in zip(scores.tolist(), names.tolist()) if s > 0]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in on], pa.int64()) for n in range(3)], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query long, doc_id long, score long")


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of the index for each item."""
    index = spark.read.schema(INDEX).parquet(f"{path}/blocks")
    documents, total = spark.read.parquet(f"{path}/sizes").first()
    asked = items.groupBy(F.col(item_col).cast("long").alias("item_id")).agg(F.max(F.col(text_col).cast("string")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = size // BATCH_BYTES + 1
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for batch in range(batches if documents else 0):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == batch).collect()  # BATCH_BYTES or so
        queries = Queries([(r["item_id"], r["text"]) for r in rows])
        queries.weigh(_frequencies(index, queries), documents)
        found = _best(index, queries, _floors(index, queries, k), k, documents, total)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
        names = spark.createDataFrame(list(enumerate(queries.ids)), "query long, item_id long")
        ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k).join(names, "query")
        out = out.unionByName(ranked.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
    return out


def rank_all(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", path: str | None = None) -> DataFrame:
    """Index all documents and rank them for each item."""
    spark = docs.sparkSession
    path = path or scratch(spark, "lexical-index")
    build(docs, path, id_col, text_col)
    return search(spark, path, items, k, item_col)
