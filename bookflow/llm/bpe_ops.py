"""BPE encoding and decoding of whole texts, by batched numpy merge rounds (see :mod:`bookflow.llm.bpe`).

Defined results: a null text is encoded as the empty text (no ids, decodes to ""); equal texts give equal ids; any length
is encoded whole; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.bpe import Decoder, MergingTextEncoder, rows_of, worker_encoder


def encode(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        encoder = worker_encoder(spec.value, MergingTextEncoder)
        for batch in (part for whole in batches for part in rows_of(whole)):
            ids = list(encoder.encode(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_json: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids)."""
    spec = encoded.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        decoder = Decoder(spec.value)
        for batch in (part for whole in batches for part in rows_of(whole)):
            texts = [decoder.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    source = encoded.select(F.col(id_col).cast("long").alias("id"), "ids")
    return source.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and fingerprint both in one pass: (id, n_tokens, ids_sha256, decoded_sha256)."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        encoder, decoder = worker_encoder(spec.value, MergingTextEncoder), Decoder(spec.value)
        for batch in (part for whole in batches for part in rows_of(whole)):
            sizes, coded, plain = [], [], []
            for ids in encoder.encode(batch.column(1).to_pylist()):
                sizes.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                plain.append(hashlib.sha256(decoder.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
