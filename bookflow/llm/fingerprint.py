"""Fingerprints of whole texts that stay alike under edits: quartile digests of hashed byte triplets.

1. Every three neighbouring bytes of the text in UTF-8 (two zero bytes before and after it) are hashed to one of 1,024
   buckets and counted.
2. A bucket's count is encoded by the quartile of all buckets' counts that it lies in: two bits, 0 up to the first quartile,
   3 above the third. The digest is a byte for the length (eighths of powers of two) and these 256 bytes, in hex.
3. Two digests differ by the sum of the buckets' steps plus the length's steps (at most 64 of them count); the difference is
   bounded by what unrelated codes come to, 1.25 steps a bucket. Likeness is 1 - difference / bound.

Texts are compared with their neighbours by id: rows are dealt by ranges of (id, hash of the text, row), sorted, and each task
walks its range with one row in hand. Only a range's first and last row meet others': two rows a task, joined afterwards.

Defined results: a null text is empty; a null id comes first; rows that repeat an id lie side by side, ordered by a hash of
their texts; a single row is its own neighbour; equal texts have equal fingerprints, and the empty text's is all zeros; an
empty table gives no rows; other columns are ignored. Half of a surrogate pair can't occur in a Spark string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.bpe import rows_of
from bookflow.llm.common import materialize

#: Bits of a bucket's number.
BUCKET_BITS = 10
BUCKETS = 1 << BUCKET_BITS
#: Steps of two unrelated two-bit codes, on average; steps of length that count at most.
UNRELATED, LENGTH_STEPS = 1.25, 64
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows of a range: results (kind 0), its first row (1) and its last (2).
WALKED = f"kind int, part int, {RESULT}, text string"
EMPTY = bytes(1 + BUCKETS // 4)


def triplet_counts(raw: bytes) -> np.ndarray:
    """How many of the text's byte triplets fall into each bucket."""
    a = np.frombuffer(b"\0\0" + raw + b"\0\0", np.uint8).astype(np.uint32)
    h = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return np.bincount(h >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)


def digest(text: str | None) -> bytes:
    """The length's byte, then two bits a bucket."""
    raw = (text or "").encode()
    if not raw:
        return EMPTY
    counts = triplet_counts(raw)
    cuts = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > cuts[0]).astype(np.uint8) + (counts > cuts[1]) + (counts > cuts[2])
    packed = code[0::4] << 6 | code[1::4] << 4 | code[2::4] << 2 | code[3::4]
    return bytes([min(255, round(8 * np.log2(1 + len(raw))))]) + packed.astype(np.uint8).tobytes()


#: Steps between the four codes of two bytes.
STEPS = np.array([[sum(abs((x >> s & 3) - (y >> s & 3)) for s in (0, 2, 4, 6)) for y in range(256)] for x in range(256)], np.int16)


def likeness(x: bytes, y: bytes) -> float:
    """1 for equal digests, 0 for those that differ as unrelated ones do, or more."""
    if x == y:
        return 1.0
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    steps = int(STEPS[a[1:], b[1:]].sum()) + min(LENGTH_STEPS, abs(int(a[0]) - int(b[0])))
    return 1 - min(1.0, steps / (UNRELATED * BUCKETS))


def edited(text: str, following: str) -> str:
    """The last half of a text, rounded down, replaced by as many characters of the next text's start (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Row:
    """A document in hand."""

    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.digest = digest(self.text)

    def beside(self, following: Row) -> tuple:
        changed = edited(self.text, following.text)
        other = self.digest if changed == self.text else digest(changed)
        return self.doc_id, len(self.text), hashlib.sha256(changed.encode()).hexdigest(), self.digest.hex(), other.hex(), likeness(self.digest, other), likeness(self.digest, following.digest)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a sorted range's rows but the last, and its first and last row."""
    schema, part = _arrow(WALKED), TaskContext.get().partitionId()
    first = last = None
    for batch in (small for whole in batches for small in rows_of(whole)):
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            row = Row(doc_id, text)
            if last is not None:
                out.append((0, part, *last.beside(row), None))
            first, last = first or row, row
        if out:
            yield _batch(out, schema)
    if last is not None:
        yield _batch([(kind, part, row.doc_id, *[None] * 6, row.text) for kind, row in ((1, first), (2, last))], schema)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of ranges' last rows from (doc_id, text, next_id, next_text)."""
    for batch in (small for whole in batches for small in rows_of(whole, 16)):
        yield _batch([Row(a, s).beside(Row(b, t)) for a, s, b, t in zip(*(c.to_pylist() for c in batch.columns))], _arrow(RESULT))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row; nothing is shuffled."""

    def run(batches):
        for batch in (small for whole in batches for small in rows_of(whole)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([digest(t).hex() for t in texts], pa.string())], names=["id", "n_chars", "fingerprint"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its text with the last half replaced by the next row's start, and both likenesses."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("row"))
    keys = ["doc_id", "hash", "row"]
    walked, _ = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(walk, WALKED), "fingerprints")
    parts = sorted(r["part"] for r in walked.filter("kind = 1").select("part").collect())  # one a task
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    firsts = walked.filter("kind = 1").select(F.col("part").alias("following"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    lasts = walked.filter("kind = 2").select("part", "doc_id", "text").join(following, "part").join(firsts, "following")
    ends = lasts.select("doc_id", "text", "next_id", "next_text").mapInArrow(meet, RESULT)
    return walked.filter("kind = 0").select(*ends.columns).unionByName(ends).withColumnRenamed("doc_id", id_col)
