"""Byte-level BPE: splitting texts into pre-tokens, an encoder that merges in batched numpy rounds, and a decoder.

A pre-token is merged on its own, so both encoders encode distinct parts of texts once and look the others up in a bounded
cache: :class:`MergingTextEncoder` by this module's own merge rounds, :class:`LibraryEncoder` by the ``tokenizers`` library.

The tokenizer file is read on the driver and travels to executors as a string (its size doesn't depend on the data).
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
from tokenizers import Tokenizer

#: Byte-level BPE shows each byte as a printable character; printable bytes stand for themselves.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Characters for which this module's splitting pattern is known to agree with the library's, whatever Unicode version either has.
PLAIN = "\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ"
NOT_PLAIN = re.compile(f"[^{PLAIN}]")
#: Fixed value: the published splitting pattern of this vocabulary, written for ``re`` over PLAIN characters.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Distinct pre-tokens that a worker remembers.
CACHE_WORDS = 1_200_000
#: What a stretch between single spaces can't begin or end with: nothing, blanks, and the mark of a first stretch.
EDGES = {"", "\0", *"\t\n\r\xa0"}
#: Characters beyond which a word isn't remembered.
LONG_WORD = 100
#: Bytes beyond which a word is merged through a queue of ranks.
QUEUED_BYTES = 512
#: Characters encoded at once.
CHUNK_CHARS = 1_000_000


def byte_chars() -> list[str]:
    """The character that stands for each byte."""
    spare = iter(range(256, 512))
    printable = set(PRINTABLE)
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Splitter:
    """Texts to pre-tokens, special tokens apart. A text with unusual characters is split by the library itself."""

    def __init__(self, tokenizer_json: str):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = json.loads(tokenizer_json).get("added_tokens") or []
        self.special = {t["content"]: t["id"] for t in added}
        self.by_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.unbyte = {c: b for b, c in enumerate(byte_chars())}

    def _odd(self, text: str) -> list[str]:
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(self.unbyte[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in pieces]

    def split(self, text: str) -> list[str]:
        if self.by_special is not None and any(s in text for s in self.special):
            return [w for part in self.by_special.split(text) if part for w in ([part] if part in self.special else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        return self._odd(text) if NOT_PLAIN.search(text) else SPLIT.findall(text)


class LibraryEncoder:
    """Whole texts to ids with the tokenizers library, each distinct stretch between spaces once.

    The splitting pattern always begins a pre-token at a space between two other characters, and at a line end between
    them, so what stands between is encoded on its own. New stretches are encoded many at once in one text that surely splits between them; the
    ids are dealt back by the bytes that they stand for. Texts to which this doesn't apply (runs of blanks, unusual
    characters, special tokens) are given to the library whole.
    """

    def __init__(self, tokenizer_json: str):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # What is new here isn't in the library's own memory of words either: a second copy doesn't look there.
        self.rare = Tokenizer.from_str(tokenizer_json)
        self.rare.no_truncation()
        self.rare.no_padding()
        if hasattr(self.rare.model, "_resize_cache"):
            self.rare.model._resize_cache(0)
        self.special = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens") or []]
        self.sizes = Decoder(tokenizer_json).sizes
        self.ends = {c: self._whole(c) for c in ",."}
        self.fixed = {"\n": self._whole("\n")}
        self.cache: dict[str, bytes | bool] = dict(self.fixed)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _joined(self, stretches: list[str], before: str) -> list[bytes]:
        text = before + before.join(stretches)
        ids = np.array(self.rare.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum(self.sizes[ids])
        stop = np.cumsum(np.fromiter(map(len, map(str.encode, stretches)), np.int64, len(stretches)) + 1)
        last = np.searchsorted(ends, stop, side="left")
        if not np.array_equal(ends[np.minimum(last, len(ends) - 1)], stop):
            return []  # a token reaches across a space: such texts go to the library whole
        raw, last = ids.tobytes(), (4 * (last + 1)).tolist()
        # A space is part of what follows it; a line end before a text's first stretch is an id of its own.
        skip = 4 if before == "\n" else 0
        return [raw[a + skip : b] for a, b in zip([0, *last], last)]

    def _learn(self, new: list[str]) -> None:
        """A stretch that has blanks at an end can't stand between single spaces: False. NUL marks a text's first stretch.

        A comma or full stop after a letter is a pre-token, so such a stretch takes the ids of the rest, and one more.
        """
        cache = self.cache
        stems = {w: w[:-1] for w in new if w[-1:] in self.ends and w[-2:-1].isalpha()}
        needed = [w for w in set(new).difference(stems).union(stems.values()) if w not in cache]
        edge = [w for w in needed if w[:1] in EDGES or w[-1:] in EDGES]
        first = [w for w in edge if w[:1] == "\0" and w[1:2] not in EDGES and w[-1] not in EDGES]
        cache.update(dict.fromkeys(set(edge).difference(first), False))
        for group, before in ((list(set(needed).difference(edge)), " "), (first, "\n")):
            for a in range(0, len(group), 5_000):
                part = group[a : a + 5_000]
                cache.update(zip(part, self._joined([w[1:] for w in part] if before == "\n" else part, before) or [False] * len(part)))
        cache.update((w, cache[stem] and cache[stem] + self.ends[w[-1]]) for w, stem in stems.items())
        new += set(stems.values())

    def encode(self, texts: list[str | None]):
        """Yield the ids of each text as little-endian unsigned 32-bit bytes."""
        for chunk in chunks(texts):
            yield from self._encode(chunk)

    def _encode(self, texts: list[str]):
        found, missing, known = [], [], self.cache.get
        for text in texts:
            plain = text and not NOT_PLAIN.search(text) and not any(t in text for t in self.special)
            # A line end between two words is a pre-token too, and begins a first stretch.
            stretches = ("\0" + text.replace("\n", " \n \0")).split(" ") if plain else []
            ids = list(map(known, stretches))
            at = [k for k, x in enumerate(ids) if x is None]
            stretches = [stretches[k] for k in at]
            missing += stretches
            found.append((ids, at, stretches))
        new = list(set(missing))
        if new:
            self._learn(new)
        for text, (ids, at, stretches) in zip(texts, found):
            for k, w in zip(at, stretches):
                ids[k] = self.cache[w]
            try:
                yield b"".join(ids) if ids else self._whole(text)
            except TypeError:  # a False: blanks that aren't single spaces
                yield self._whole(text)
        forget(self.cache, new)
        self.cache.update(self.fixed)


class MergeEncoder:
    """Distinct pre-tokens to ids by merge rounds over one flat symbol array.

    Each round looks up every neighbouring pair of every unfinished word by binary search in the sorted array of pair
    keys, takes each word's lowest rank, and merges all its occurrences from left to right. A merge makes pairs of a
    higher rank only (their rule needs the merged symbol), so merging all occurrences at once equals merging one by one.
    A round looks at all of a word, so very long words take their ranks from a queue instead: a merge then costs the pairs
    that it touches, whatever the word's length.
    """

    def __init__(self, tokenizer_json: str):
        self.splitter = Splitter(tokenizer_json)
        self.special = self.splitter.special
        model = json.loads(tokenizer_json)["model"]
        vocab = model["vocab"]
        self.base = np.array([vocab[c] for c in byte_chars()], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] for a, _ in merges], dtype=np.int64) * self.width + np.array([vocab[b] for _, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.never = np.int64(len(merges))

    def encode_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        long_ones = [k for k, r in enumerate(raw) if len(r) > QUEUED_BYTES]
        if not long_ones:
            return self._rounds(raw)
        out = self._rounds([b"" if len(r) > QUEUED_BYTES else r for r in raw])
        for k in long_ones:
            out[k] = self._queued(self.base[np.frombuffer(raw[k], np.uint8)]).astype("<u4").tobytes()
        return out

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols, ``never`` for those without a rule: binary search in the sorted pair keys."""
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], self.never)

    def _queued(self, symbols: np.ndarray) -> np.ndarray:
        """One word: all occurrences of the lowest rank merge together, and only the pairs beside them are looked up again."""
        n = len(symbols)
        symbols, after, before = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, self.never)  # of the pair that begins at a position; never where there is none any more
        alive = np.ones(n, bool)
        rank[: n - 1] = self.ranks_of(symbols[:-1], symbols[1:])
        waiting: dict[int, list[int]] = {}
        queue: list[int] = []

        def wait(at: np.ndarray) -> None:
            for r, k in zip(rank[at].tolist(), at.tolist()):
                if r < self.never:
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(queue, r)
                    waiting[r].append(k)

        wait(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.array(waiting.pop(r), np.int64))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # Of a run of overlapping occurrences (the same symbol again and again) every other one merges.
            index = np.arange(len(at))
            first = np.r_[True, after[at[:-1]] != at[1:]]
            at = at[(index - np.maximum.accumulate(np.where(first, index, -1))) % 2 == 0]
            gone = after[at]
            symbols[at] = self.merged[r]
            alive[gone], rank[gone] = False, self.never
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            paired = after[touched] < n
            rank[touched] = self.never
            rank[touched[paired]] = self.ranks_of(symbols[touched[paired]], symbols[after[touched[paired]]])
            wait(touched)
        return symbols[alive]

    def _rounds(self, raw: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.base[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        done_symbols, done_word = [], []
        while len(symbols):
            rank = np.full(len(symbols), self.never)
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = self.ranks_of(symbols[inside], symbols[inside + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(word)])
            low = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            chosen = (rank == low) & (low < self.never)
            # Of a run of overlapping occurrences (the same symbol again and again) every other one merges.
            first = chosen & ~np.r_[False, chosen[:-1]]
            index = np.arange(len(chosen))
            since = index - np.maximum.accumulate(np.where(first, index, -1))
            chosen &= since % 2 == 0
            finished = low == self.never
            done_symbols.append(symbols[finished])
            done_word.append(word[finished])
            symbols = np.where(chosen, self.merged[np.where(chosen, rank, 0)], symbols)
            stay = ~np.r_[False, chosen[:-1]] & ~finished
            symbols, word = symbols[stay], word[stay]
        symbols, word = np.concatenate(done_symbols or [symbols]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        bounds = (4 * np.searchsorted(word[order], np.arange(len(raw) + 1))).tolist()
        flat = symbols[order].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


class MergingTextEncoder:
    """Whole texts to ids by :class:`MergeEncoder`, each distinct pre-token once."""

    def __init__(self, tokenizer_json: str):
        self.encoder = MergeEncoder(tokenizer_json)
        self.fixed = {w: np.array([i], dtype="<u4").tobytes() for w, i in self.encoder.special.items()}
        self.cache = dict(self.fixed)

    def encode(self, texts: list[str | None]):
        """Yield the ids of each text as little-endian unsigned 32-bit bytes."""
        for chunk in chunks(texts):
            yield from self._encode(chunk)

    def _encode(self, texts: list[str]):
        split = [self.encoder.splitter.split(t) for t in texts]
        distinct = set().union(*split)
        new = list(distinct.difference(self.cache))
        if new:
            self.cache.update(zip(new, self.encoder.encode_words(new)))
        get = self.cache.__getitem__
        for words in split:
            yield b"".join(map(get, words))
        forget(self.cache, new)
        self.cache.update(self.fixed)


def chunks(texts: list[str | None]):
    """Lists of texts of about CHUNK_CHARS characters together; null is empty."""
    chunk, held = [], 0
    for text in texts:
        chunk.append(text or "")
        held += len(chunk[-1])
        if held > CHUNK_CHARS:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def forget(cache: dict, new: list[str]) -> None:
    """Keep a worker's memory bounded: over CACHE_WORDS the chunk's new words go, but if they are very many, the old ones."""
    if len(cache) > CACHE_WORDS:
        if len(new) > CACHE_WORDS // 8:
            cache.clear()
        for word in new:
            cache.pop(word, None)
    else:
        for word in new:
            if len(word) > LONG_WORD:
                cache.pop(word, None)


def rows_of(batch, count: int = 256):
    """A record batch in slices, so that few rows at a time become Python objects."""
    for at in range(0, batch.num_rows, count):
        yield batch.slice(at, count)


class Decoder:
    """Ids to text, as the byte-level decoder of the library does."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        unbyte = {c: b for b, c in enumerate(byte_chars())}
        tokens = {i: bytes(unbyte[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in unbyte for c in t)}
        tokens |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens") or []}
        parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.sizes[ids]
        at = np.repeat(self.offsets[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.bytes[at].tobytes().decode("utf-8", "replace")


_ENCODERS: dict = {}


def worker_encoder(tokenizer_json: str, kind: type = LibraryEncoder):
    """This worker process's encoder: reused workers keep the pre-tokens they know."""
    key = (kind.__name__, hash(tokenizer_json))
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(tokenizer_json)
    return _ENCODERS[key]


def read_tokenizer(path: str) -> str:
    """A tokenizer file, read on the driver; it is a few MB whatever the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()
