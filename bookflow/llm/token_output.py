"""Token-ID binary output: documents' ids in ascending id order, in Huffman-coded blocks that decode independently.

Format (a folder in shared storage):

* ``codebook``: one row, ``lengths``: the code length of every id (canonical code, so lengths say all).
* ``blocks``: rows (part, block, first, doc_ids, n_ids, n_bytes, payload). Blocks of a part follow each other, parts too;
  ``first`` counts the part's ids before the block. A payload is the magic ``HIB1``, the number of checkpoints (u32), the
  checkpoints (u32: bit offsets, one per document and 256 ids, from the document's first byte), and the bits. Each
  document starts at a byte; any checkpoint starts an independent decode.

Counts that make the code are global, over every id of every document. The code table, and what the driver gathers, is as
large as the vocabulary. Documents are range-partitioned by id after coding, so the shuffle carries coded bits.

Defined results: a null text is empty and gives the end id only; a null document id sorts first; rows that repeat an id
are all written, side by side; an empty table gives empty files and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.llm import huffman
from bookflow.llm.bpe import rows_of, worker_encoder
from bookflow.llm.common import materialize, remove, scratch

MAGIC = b"HIB1"
#: Ids a block holds before the next one starts; documents aren't split.
BLOCK_IDS = 65_536
#: Ids decoded at once in a worker.
CHUNK_IDS = 2_000_000


def binary_column(flat: bytes, sizes: np.ndarray) -> pa.Array:
    """An Arrow column of byte strings from their concatenation; no string becomes a Python object."""
    offsets = np.r_[0, np.cumsum(sizes)].astype("<i4").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def flat_bytes(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """(the concatenation of a column's byte strings, their sizes)."""
    offsets = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset).astype(np.int64)
    return memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]], np.diff(offsets)


def token_ids(docs: DataFrame, tokenizer_json: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, doc_id, ids): ids with the end id, as unsigned 16-bit integers where the vocabulary allows it, else 32-bit.

    Rows of kind 0 are documents. Each task also gives one row of kind 1, whose ``ids`` are its counts of all ids (64-bit).
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    width, end = id_width(vocabulary), end_id.to_bytes(4, "little")

    def run(batches):
        encoder = worker_encoder(spec.value)
        counts = np.zeros(vocabulary, np.int64)
        for batch in (part for whole in batches for part in rows_of(whole)):
            ids = [x + end for x in encoder.encode(batch.column(1).to_pylist())]
            flat = np.frombuffer(b"".join(ids), "<u4")
            counts += np.bincount(flat, minlength=vocabulary)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) * np.dtype(width).itemsize // 4
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), batch.column(0), binary_column(flat.astype(width).tobytes(), sizes)], names=["kind", "doc_id", "ids"])
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=["kind", "doc_id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "kind int, doc_id long, ids binary")


def id_width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _groups(rows, weight, most):
    """Rows in lists of about ``most`` weight."""
    held, load = [], 0
    for row in rows:
        held.append(row)
        load += weight(row)
        if load >= most:
            yield held
            held, load = [], 0
    if held:
        yield held


def _rows(batches, *names):
    for batch in (part for whole in batches for part in rows_of(whole)):
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def id_counts(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """Global counts of every id: the tasks' counts are summed by id; the driver gets a row for each id that occurs."""

    def run(batches):
        for (raw,) in _rows(batches, "ids"):
            counts = np.frombuffer(raw, np.int64)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for row in ids.filter("kind = 1").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def split_points(ids: DataFrame, parts: int) -> np.ndarray:
    """Document ids that cut the table into about equal ranges; one for each part but the last."""
    shares = [k / parts for k in range(1, parts)]
    if not shares:
        return np.empty(0, np.int64)
    found = ids.filter("kind = 0").agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0]
    return np.unique(np.array(found or [], np.int64))


def slot_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each part a number that hash partitioning sends to the task of that position: one part a task, files in order."""
    found = dict(spark.range(40 * parts).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("part"), F.col("id").cast("int").alias("key")).groupBy("part").agg(F.min("key")).collect())
    return [found.get(part, part) for part in range(parts)]


def write(docs: DataFrame, tokenizer_json: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode, count, code and write."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1)
    width = id_width(vocabulary)
    ids, held = materialize(token_ids(docs, tokenizer_json, end_id, vocabulary, id_col, text_col), "token-ids")
    lengths = huffman.code_lengths(id_counts(ids, vocabulary))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    book = spark.sparkContext.broadcast((lengths, huffman.canonical_codes(lengths), split_points(ids, parts)))
    slots = np.array(slot_keys(spark, parts), np.int32)

    def code(batches):
        *codes, splits = book.value
        for batch in (part for whole in batches for part in rows_of(whole, 1024)):
            flat, sizes = flat_bytes(batch.column(1))
            counts = sizes // np.dtype(width).itemsize
            raw, spans, marks = huffman.pack(np.frombuffer(flat, width), counts, *codes)
            # As whole numbers throughout: doubles would take neighbouring large ids for one. No id comes first.
            absent = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            part = np.where(absent, 0, np.searchsorted(splits, batch.column(0).fill_null(0).to_numpy(), side="right"))
            yield pa.RecordBatch.from_arrays([pa.array(slots[part]), pa.array(part.astype(np.int32)), batch.column(0), pa.array(counts), binary_column(marks.astype("<u4").tobytes(), 4 * huffman.lots(counts)[0]), binary_column(raw, spans)], names=["slot", "part", "doc_id", "n", "marks", "bits"])

    def block(batches):
        last, number, first = None, 0, 0
        for same in _by_part(_rows(batches, "part", "doc_id", "n", "marks", "bits")):
            if same[0][0] != last:
                last, number, first = same[0][0], 0, 0
            marks = b"".join(r[3] for r in same)
            payload = MAGIC + np.array([len(marks) // 4], "<u4").tobytes() + marks + b"".join(r[4] for r in same)
            n = [r[2] for r in same]
            yield pa.RecordBatch.from_pydict({"part": [last], "block": [number], "first": [first], "doc_ids": [[r[1] for r in same]], "n_ids": [n], "n_bytes": [[len(r[4]) for r in same]], "payload": [payload]}, schema=BLOCK_ARROW)
            number, first = number + 1, first + sum(n)

    coded = ids.filter("kind = 0").select("doc_id", "ids").mapInArrow(code, "slot int, part int, doc_id long, n long, marks binary, bits binary")
    ordered = coded.repartition(parts, "slot").drop("slot").sortWithinPartitions("part", "doc_id", "n", "bits")
    ordered.mapInArrow(block, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    remove(spark, held)


def _by_part(rows):
    """Blocks: rows of one part, BLOCK_IDS ids or so."""
    held, load = [], 0
    for row in rows:
        if held and (load >= BLOCK_IDS or row[0] != held[0][0]):
            yield held
            held, load = [], 0
        held.append(row)
        load += row[2]
    if held:
        yield held


BLOCKS = "part int, block int, first long, doc_ids array<long>, n_ids array<long>, n_bytes array<long>, payload binary"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("payload", pa.binary())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, from the files alone."""
    return _decoded(spark, path, "ids binary", lambda ids: ids.tobytes())


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read`, with the ids' CRC-32 instead of the ids."""
    return _decoded(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()))


def _decoded(spark: SparkSession, path: str, field: str, shown) -> DataFrame:
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first()["lengths"], np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row per part, that is per task that wrote.
    totals = dict(blocks.select("part", F.explode("n_ids").alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect())
    offsets, total = {}, 0
    for part in sorted(totals):
        offsets[part], total = total, total + totals[part]
    book = spark.sparkContext.broadcast(lengths)
    name, kind = field.split(" ")
    kind = pa.binary() if kind == "binary" else pa.int64()

    def run(batches):
        tables = huffman.decode_tables(book.value)
        for group in _groups(_rows(batches, "part", "first", "doc_ids", "n_ids", "n_bytes", "payload"), lambda r: sum(r[3]), CHUNK_IDS):
            out = {"doc_id": [], "start": [], "n_tokens": [], name: []}
            raw, lanes, sizes, at = [], [], [], 0
            for part, first, doc_ids, n_ids, n_bytes, payload in group:
                if payload[:4] != MAGIC:
                    raise ValueError("not a block of token ids")
                n, spans = np.array(n_ids, np.int64), np.array(n_bytes, np.int64)
                marks = np.frombuffer(payload, "<u4", int.from_bytes(payload[4:8], "little"), 8).astype(np.int64)
                bits = payload[8 + 4 * len(marks) :]
                each, within = huffman.lots(n)
                lanes.append(marks + 8 * (at + np.repeat(np.cumsum(spans) - spans, each)))
                sizes.append(np.minimum(huffman.EVERY, np.repeat(n, each) - huffman.EVERY * within))
                raw.append(bits)
                at += len(bits)
                out["doc_id"] += doc_ids
                out["n_tokens"] += n_ids
                out["start"] += (offsets[part] + first + np.cumsum(n) - n).tolist()
            ids = huffman.unpack(b"".join(raw), np.concatenate(lanes), np.concatenate(sizes), tables).astype("<u4")
            ends = np.cumsum(out["n_tokens"]).tolist()
            out[name] = [shown(ids[e - n : e]) for e, n in zip(ends, out["n_tokens"])]
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in (("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind))], names=list(out))

    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {field}")


def round_trip(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the files and describe what they hold: (doc_id, start, n_tokens, ids_crc32)."""
    path = path or scratch(docs.sparkSession, "token-files")
    write(docs, tokenizer_json, path, end_id, id_col, text_col)
    return read_digest(docs.sparkSession, path)
