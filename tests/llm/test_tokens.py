"""Token output, BPE and packing: exact against the library, whole round trips, defined results for odd rows."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bookflow.llm import bpe, bpe_ops, huffman, packing, token_output
from tests.llm.helpers import ROWS, documents, empty, library_ids, tokenizer_json


@pytest.fixture(scope="module")
def spec():
    return tokenizer_json()


@pytest.fixture(scope="module")
def encoders(spec):
    return [bpe.LibraryEncoder(spec), bpe.MergingTextEncoder(spec)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcAB 'st.,!\n\t12é_|<>", max_size=80))
def test_encoders_equal_the_library(encoders, text):
    expected = library_ids([text])[0].tobytes()
    for encoder in encoders:
        assert list(encoder.encode([text])) == [expected]


def long_words():
    import random

    rng = random.Random(3)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(160_000))
    natural = "".join(rng.choice(["the", "ing", "ation", "er", "qu", "zz"]) for _ in range(3000))
    return [letters, natural, "x" * 50_000, "ab" * 3000 + "a", "é" * 3001, "日本語" * 700, "aaab" * 500]


def test_long_words_are_exact_and_fast(spec):
    import time

    encoder = bpe.MergeEncoder(spec)
    began = time.perf_counter()
    got = encoder.encode_words(["short", *long_words(), "tail"])
    assert time.perf_counter() - began < 15
    assert got == [x.tobytes() for x in library_ids(["short", *long_words(), "tail"])]


def test_queue_equals_rounds(spec, monkeypatch):
    encoder = bpe.MergeEncoder(spec)
    words = [w[:400] for w in long_words()] + ["a", "ab", "hello"]
    rounds = encoder.encode_words(words)
    monkeypatch.setattr(bpe, "QUEUED_BYTES", 0)
    assert encoder.encode_words(words) == rounds


def test_texts_go_whole_where_stretches_dont_fit(spec, monkeypatch):
    encoder = bpe.LibraryEncoder(spec)
    monkeypatch.setattr(encoder, "sizes", encoder.sizes + 1)  # as with a tokenizer whose tokens reach across spaces
    texts = ["some words, and more.", "x\ny z"]
    assert list(encoder.encode(texts)) == [x.tobytes() for x in library_ids(texts)]


def test_one_part_a_task(spark):
    from pyspark.sql import functions as F

    keys = token_output.slot_keys(spark, 7)
    rows = spark.createDataFrame(list(enumerate(keys)), "part int, slot int").repartition(7, "slot").select("part", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.part, r.task) for r in rows) == [(k, k) for k in range(7)]


def test_decoder(spec):
    decoder = bpe.Decoder(spec)
    for _, text, *_ in ROWS:
        assert decoder.decode(library_ids([text])[0]) == (text or "")


def test_memory_stays_bounded(spec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    for encoder in (bpe.LibraryEncoder(spec), bpe.MergingTextEncoder(spec)):
        for k in range(20):
            text = " ".join(f"w{k}x{i}" for i in range(30))
            assert list(encoder.encode([text])) == [library_ids([text])[0].tobytes()]
            assert len(encoder.cache) <= 60


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=400))
def test_code_lengths(counts):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, 9)
    used = lengths[counts > 0].astype(int)
    assert (lengths[counts == 0] == 0).all() and (not len(used) or used.max() <= 9)
    if len(used) > 1:
        assert (2.0**-used).sum() == 1


def test_limited_code_is_optimal():
    import itertools

    counts = np.array([1, 1, 2, 3, 5, 8, 13])
    best = min(sum(c * n for c, n in zip(counts, ls)) for ls in itertools.product(range(1, 5), repeat=len(counts)) if sum(2.0**-n for n in ls) <= 1)
    assert (huffman.code_lengths(counts, 4) * counts).sum() == best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=700), max_size=6))
def test_bits_round_trip(docs):
    flat = np.array([x for d in docs for x in d], np.int64)
    counts = np.array([len(d) for d in docs], np.int64)
    lengths = huffman.code_lengths(np.bincount(flat, minlength=41) if len(flat) else np.zeros(41, int), 7)
    raw, spans, marks = huffman.pack(flat, counts, lengths, huffman.canonical_codes(lengths))
    each, within = huffman.lots(counts)
    starts = 8 * (np.cumsum(spans) - spans)
    sizes = np.minimum(huffman.EVERY, np.repeat(counts, each) - huffman.EVERY * within)
    assert huffman.unpack(raw, marks + np.repeat(starts, each), sizes, huffman.decode_tables(lengths)).tolist() == flat.tolist()


def test_token_files(spark, spec, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_output.write(documents(spark), spec, path, end_id=2)
    rows = token_output.read(spark, path).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    expected = [np.append(x, np.uint32(2)) for x in library_ids(r[1] for r in order)]
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [r[0] for r in order]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == [x.tolist() for x in expected]
    assert [r.start for r in rows] == (np.cumsum([len(x) for x in expected]) - [len(x) for x in expected]).tolist()
    digests = {r.start: r.ids_crc32 for r in token_output.read_digest(spark, path).collect()}
    assert digests == {r.start: zlib.crc32(bytes(r.ids)) for r in rows}
    assert token_output.round_trip(empty(spark), spec, 2).count() == 0


def test_token_files_of_large_ids(spark, spec, tmp_path):
    """Neighbouring ids that are one number as doubles, beside a document without an id: still in order of their ids."""
    ids = [2**60 + k for k in range(2000)]
    docs = spark.createDataFrame([(None, "none"), *((i, f"word {i}") for i in ids[::2] + ids[1::2])], "doc_id long, text string").coalesce(1)
    token_output.write(docs, spec, f"file://{tmp_path}/tokens", end_id=2)
    rows = sorted(token_output.read(spark, f"file://{tmp_path}/tokens").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *ids]


def test_bpe(spark, spec):
    rows = bpe_ops.digest(documents(spark), spec).collect()
    expected = {(r[0], r[1]): x for r, x in zip(ROWS, library_ids(r[1] for r in ROWS))}
    want = sorted((d or 0, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (d, t), x in [*expected.items(), next(i for i in expected.items() if i[0][0] == 12)])
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    back = bpe_ops.decode(bpe_ops.encode(documents(spark), spec), spec)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((r[0] or 0, r[1] or "") for r in ROWS)
    assert bpe_ops.digest(empty(spark), spec).count() == 0


def check_packing(rows, docs, window=2048):
    """Every id once, windows full or a power of two, offsets without gaps."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (doc_id, tokens), pieces in by_doc.items():
        copies = sum(1 for d, x in docs if d == doc_id and len(x) == tokens)
        assert sum(p.length for p in pieces) == tokens * copies
        whole = next(x for d, x in docs if d == doc_id and len(x) == tokens).astype("<u4")
        assert all(zlib.crc32(whole[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window and at & (at - 1) == 0


def test_packing(spark, spec):
    docs = [(r[0], np.append(x, np.uint32(1))) for r, x in zip(ROWS, library_ids(r[1] for r in ROWS))]
    rows = packing.pack(documents(spark), spec, end_id=1).collect()
    check_packing(rows, docs)
    small = packing.pack(documents(spark), spec, end_id=1, buffer_tokens=500, with_ids=True).collect()
    check_packing(small, docs)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in small)
    assert packing.pack(empty(spark), spec).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_packer_fills_every_window(sizes):
    packer = packing.Packer((64, 32, 16))
    windows = [w for k, n in enumerate(sizes) for w in packer.add(k, n)] + packer.drain(last=False)
    assert all(sum(p[2] for p in w) in (64, 32, 16) for w in windows)
    windows += packer.drain(last=True)
    assert sum(p[2] for w in windows for p in w) == sum(sizes)
    groups = packing.step_groups(windows, 256)
    assert len(groups) == len(windows)
