"""Word-shingle sets and their MinHash signatures, one numpy pass per document."""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
SIZE = 5
#: Signature: CHUNKS chunks of LANES symbols of 16 bits; a chunk is one 64-bit integer.
CHUNKS, LANES = 20, 4

_SEED = np.random.Generator(np.random.Philox(20))
_ODD = np.uint64(1)
_BYTES = _SEED.integers(0, 2**64, 256, np.uint64)
_STEP = _SEED.integers(0, 2**64, 1, np.uint64)[0] | _ODD
_PLACE = _SEED.integers(0, 2**64, SIZE, np.uint64) | _ODD
_MUL = _SEED.integers(0, 2**64, CHUNKS * LANES, np.uint64) | _ODD
_ADD = _SEED.integers(0, 2**64, CHUNKS * LANES, np.uint64)
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(63, _STEP)], dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first n powers of the step, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _STEP)], dtype=np.uint64)
    return _POWERS[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles.

    A-Z are lower-cased; words are runs of anything but blanks and the characters 9 to 13. With fewer words than a
    shingle takes the whole sequence is one; without words there is none.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = ~_SPACE[raw]
    if not inside.any():
        return np.empty(0, np.uint64)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.r_[[0] if inside[0] else [], edge, [len(raw)] if inside[-1] else []].astype(np.int64)
    first, last = edge[::2], edge[1::2]
    sizes = last - first
    letters = raw[inside]
    at = np.cumsum(sizes) - sizes
    within = np.arange(len(letters)) - np.repeat(at, sizes)
    words = mix(np.add.reduceat(_BYTES[letters] * _powers(int(sizes.max()))[within], at) + sizes.astype(np.uint64))
    n = min(SIZE, len(words))
    total = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _PLACE[k]
    return np.unique(mix(total))


def signature(found: np.ndarray) -> np.ndarray:
    """CHUNKS signed 64-bit integers, each LANES symbols of 16 bits: a symbol shows which shingle is the least in its order."""
    low = np.full(len(_MUL), np.uint64(2**64 - 1))
    for a in range(0, len(found), 512):
        part = found[a : a + 512, None] * _MUL + _ADD
        np.minimum(low, (part ^ (part >> np.uint64(32))).min(axis=0), out=low)
    symbols = (mix(low) & np.uint64(0xFFFF)).reshape(CHUNKS, LANES)
    shift = np.arange(LANES, dtype=np.uint64) * np.uint64(16)
    return (symbols << shift).sum(axis=1, dtype=np.uint64).view(np.int64)


def digest(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that identify the set."""
    return tuple(int(x) for x in np.array([mix(found ^ np.uint64(k)).sum(dtype=np.uint64) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]).view(np.int64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
    return int((b[at] == a).sum()) if len(b) else 0
