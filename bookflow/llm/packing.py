"""Hierarchical multi-length packing of tokenised documents into training sequences.

A document (its ids and an end id) gives as many full windows as fit; the remainder is routed to the smallest context tier
that holds it. Tiers are packed from long to short: a piece opens a window of its tier, the gap takes the largest pieces
of shorter tiers that fit, and at last one piece is cut to fill the gap exactly. The last window of a task, which nothing
is left to fill, is split into windows of powers of two. So no window is padded.

Windows of a buffer are dealt to step groups of about ``step_tokens`` ids each, in snake order of their attention cost
(the sum of squared piece lengths), so the groups carry equal numbers of ids and similar work.

A task holds at most ``buffer_tokens`` ids and one document at a time, and no shuffle is needed: every task packs its own rows.

Defined results: a null text is empty (the end id alone); repeated rows are packed each; a document of any length is cut
into windows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.bpe import rows_of, worker_encoder

TIERS = (2048, 1024, 512, 256)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


class Packer:
    """Packs pieces (document, start, length) of one task; documents are opaque."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.window = self.tiers[0]
        self.by_length: list[list] = [[] for _ in range(self.window + 1)]
        self.lengths = 0  # bit l is set while a piece of l ids waits

    def _put(self, doc, start: int, length: int) -> None:
        self.by_length[length].append((doc, start, length))
        self.lengths |= 1 << length

    def _take(self, length: int):
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            self.lengths &= ~(1 << length)
        return piece

    def _largest(self, most: int) -> int:
        return (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1

    def add(self, doc, tokens: int) -> list[list]:
        """Full windows come out at once; the remainder waits."""
        full = tokens // self.window
        if tokens % self.window:
            self._put(doc, full * self.window, tokens % self.window)
        return [[(doc, k * self.window, self.window)] for k in range(full)]

    def drain(self, last: bool) -> list[list]:
        """Pack all that waits. A window that can't be filled waits for more, or, at the last, is split into powers of two."""
        out = []
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while (length := self._largest(tier)) > below:
                window, gap = [self._take(length)], tier - length
                while gap and self.lengths:
                    fit = self._largest(gap)
                    if fit > 0:
                        window.append(self._take(fit))
                        gap -= fit
                    else:  # all pieces are longer: cut the shortest
                        doc, start, size = self._take((self.lengths & -self.lengths).bit_length() - 1)
                        window.append((doc, start, gap))
                        self._put(doc, start + gap, size - gap)
                        gap = 0
                if not gap:
                    out.append(window)
                elif last:
                    out += powers_of_two(window)
                else:
                    for piece in window:
                        self._put(*piece)
                    return out
        return out


def powers_of_two(pieces: list) -> list[list]:
    """Cut pieces into windows whose sizes are the powers of two that sum to their ids, the largest first."""
    total, out = sum(p[2] for p in pieces), []
    pieces = pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            room, window = 1 << bit, []
            while room:
                doc, start, length = pieces.pop()
                window.append((doc, start, min(room, length)))
                if length > room:
                    pieces.append((doc, start + room, length - room))
                room -= window[-1][2]
            out.append(window)
    return out


def step_groups(windows: list[list], step_tokens: int) -> list[int]:
    """The step group of each window: equal ids, similar attention cost."""
    groups = max(1, -(-sum(p[2] for w in windows for p in w) // step_tokens))
    group = [0] * len(windows)
    tiers: dict[int, list[int]] = {}
    for k, w in enumerate(windows):
        tiers.setdefault(sum(p[2] for p in w), []).append(k)
    dealt = 0
    for size in sorted(tiers, reverse=True):
        for k in sorted(tiers[size], key=lambda k: -sum(p[2] ** 2 for p in windows[k])):
            turn, place = divmod(dealt, groups)
            group[k] = place if turn % 2 == 0 else groups - 1 - place
            dealt += 1
    return group


def pack(docs: DataFrame, tokenizer_json: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = 16_384, buffer_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; with ``with_ids`` also the piece's ids (little-endian unsigned 32-bit)."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = SCHEMA + (", ids binary" if with_ids else "")
    fields = pa.schema([(c.split(" ")[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in schema.split(", ")])

    def run(batches):
        encoder, packer = worker_encoder(spec.value), Packer(tiers)
        end = end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 36
        made, steps = base, base

        def rows(windows):
            nonlocal made, steps
            out = {f.name: [] for f in fields}
            groups = step_groups(windows, step_tokens)
            for window, group in zip(windows, groups):
                offset, tokens = 0, sum(p[2] for p in window)
                for (doc_id, ids), start, length in window:
                    piece = ids[4 * start : 4 * (start + length)]
                    for name, value in (("doc_id", doc_id), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(piece)), ("doc_tokens", len(ids) // 4), ("sequence_id", made), ("offset", offset), ("sequence_tokens", tokens), ("step_group", steps + group)):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(piece)
                    offset += length
                made += 1
            steps += max(groups, default=-1) + 1
            return pa.RecordBatch.from_pydict(out, schema=fields)

        windows, held = [], 0
        for batch in (part for whole in batches for part in rows_of(whole)):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                doc = (doc_id, ids + end)
                windows += packer.add(doc, len(doc[1]) // 4)
                held += len(doc[1]) // 4
                if held >= buffer_tokens:
                    yield rows(windows + packer.drain(last=False))
                    windows, held = [], 0
        yield rows(windows + packer.drain(last=True))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema)
