"""Canonical length-limited Huffman code over token ids: building it, packing ids to bits, decoding from checkpoints."""

from __future__ import annotations

import numpy as np

#: Ids between two bit-offset checkpoints of a document.
EVERY = 256
#: Longest code word in bits; more only where the alphabet itself needs more.
LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for symbols that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # Level by level, a list holds leaves and packages of two of the list before, by weight. To take the first 2n-2 of
    # the last list means to take the first t leaves and the packages before that place, and so on down.
    is_leaf, current = [], weights
    for _ in range(limit - 1):
        packages = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        is_leaf.append(rank < n)
        current = merged[rank]
    out = np.zeros(n, np.int64)
    take = 2 * n - 2
    for level in reversed(is_leaf):
        leaves = int(level[:take].sum())
        out[:leaves] += 1
        take = 2 * (take - leaves)
    out[:take] += 1
    lengths[order] = out
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words in order of (length, symbol), as unsigned integers."""
    codes = np.zeros(len(lengths), np.uint64)
    code, previous = 0, 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        symbols = np.flatnonzero(lengths == size)
        code <<= size - previous
        previous = size
        codes[symbols] = code + np.arange(len(symbols))
        code += len(symbols)
    return codes


def decode_tables(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits to look at, symbol by those bits, length by those bits)."""
    bits = int(lengths.max(initial=1)) or 1
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (bits - lengths[order].astype(np.int64))
    symbol, size = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.int64)
    symbol[: spans.sum()] = np.repeat(order, spans)
    size[: spans.sum()] = np.repeat(lengths[order], spans)
    return bits, symbol, size


def lots(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(checkpoints of each document, each checkpoint's place in its document)."""
    each = (counts + EVERY - 1) // EVERY
    return each, np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)


def pack(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Documents (flat ids and the number of ids of each) to bits, each document from a byte of its own.

    Returns the bytes, the byte length of each document and all checkpoints (bit offsets from the document's start).
    """
    size = lengths[ids].astype(np.int64)
    total = np.cumsum(size)
    ends = np.cumsum(counts)
    first = ends - counts
    before = np.r_[0, total][first]
    bits = np.r_[0, total][ends] - before
    spans = (bits + 7) // 8
    starts = 8 * (np.cumsum(spans) - spans)
    at = total - size
    each, within = lots(counts)
    marks = at[np.repeat(first, each) + EVERY * within] - np.repeat(before, each) if len(ids) else np.empty(0, np.int64)
    at = at + np.repeat(starts - before, counts)
    words = np.zeros(int(spans.sum()) // 4 + 3, np.uint64)
    if len(ids):
        value = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
        word = at >> 5
        runs = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[runs]] += np.add.reduceat(value >> np.uint64(32), runs)
        words[word[runs] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), runs)
    return words.astype(">u4").tobytes()[: int(spans.sum())], spans, marks


def unpack(raw: bytes, bit_at: np.ndarray, counts: np.ndarray, tables: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """Decode many stretches side by side: each starts at a checkpoint, gives ``counts`` ids, and steps by table look-up."""
    bits, symbol, size = tables
    b = np.frombuffer(raw + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    order = np.argsort(-counts, kind="stable")
    at, left = bit_at[order].copy(), counts[order]
    place = (np.cumsum(counts) - counts)[order]
    out = np.zeros(int(counts.sum()), np.uint32)
    mask = np.uint32((1 << bits) - 1)
    for step in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(-left, -step, side="left"))
        here = at[:live]
        seen = (window[here >> 3] >> (32 - bits - (here & 7)).astype(np.uint32)) & mask
        out[place[:live] + step] = symbol[seen]
        at[:live] = here + size[seen]
    return out
