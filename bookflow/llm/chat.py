"""Chat formatting with minimum-cost repair of roles.

A legal conversation is an optional system message, then user and assistant messages in turn, the assistant last. Turns
are repaired by merging a turn into the message before it, relabelling its role, or inserting an empty message; texts are
never dropped. Dynamic programming over the automaton (state: role of the last message) finds the cheapest repair: a cost
to go is computed from the last turn backwards, then turns are labelled forwards, ties to the first of system, user,
assistant. Known other names of roles count as the role; a missing or unknown role may become any, cheaply.

Each turn comes back once, with its part of the rendered conversation: the parts of a conversation, in ``position`` order,
concatenate to its text. So no conversation is gathered anywhere: conversations are worked on in stretches of ``STRETCH``
turn numbers, and a conversation of several stretches is solved through one small min-plus matrix for each stretch.

Defined results: turns are ordered by turn number (null last), then role and text; a null or empty text is an empty
message; a row with a null conversation id is a conversation of its own; repeated rows are turns of their own; an
empty table gives no rows; other columns are ignored. Markers inside texts are spelt apart so that they can't open a message.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import materialize

MERGE, INSERT, UNKNOWN, RELABEL = 1, 2, 1, 3
ROLES = ("system", "user", "assistant")
#: Other names of roles.
ALIASES = {"human": "user", "customer": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system", "instructions": "system"}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
STRETCH = 1024
#: States: 0 nothing yet, then the last message's role: 1 system, 2 user, 3 assistant.
NEVER = 10**12
#: From state and to role: (cost, roles of inserted empty messages); absent where it can't be.
STEPS = {(0, 1): (0, ()), (0, 2): (0, ()), (0, 3): (INSERT, ("user",)), (1, 1): (MERGE, ()), (1, 2): (0, ()), (1, 3): (INSERT, ("user",)), (2, 2): (MERGE, ()), (2, 3): (0, ()), (3, 3): (MERGE, ()), (3, 2): (0, ())}
ENDS = {1: (2 * INSERT, ("user", "assistant")), 2: (INSERT, ("assistant",)), 3: (0, ())}
END = [NEVER if s not in ENDS else ENDS[s][0] for s in range(4)]
OUT = "conv_id long, turn long, position long, role string, final_role string, action string, inserted string, message long, rendered string"


def named(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    role = ALIASES.get(role, role)
    return role if role in ROLES else None


def label_cost(role: str | None, label: int) -> int:
    return UNKNOWN if role is None else 0 if ROLES[label - 1] == role else RELABEL


def costs_to_go(roles: list[str | None], end: list[int]) -> list[list[int]]:
    """For each place before a turn, and the end: the cheapest completion from each state."""
    out = [end]
    for role in reversed(roles):
        after = out[-1]
        here = [NEVER] * 4
        for (s, label), (cost, _) in STEPS.items():
            here[s] = min(here[s], cost + label_cost(role, label) + after[label])
        out.append(here)
    return out[::-1]


def matrix(roles: list[str | None]) -> list[int]:
    """The cheapest way from each state to each state through these turns, row by row."""
    columns = [costs_to_go(roles, [0 if s == e else NEVER for s in range(4)])[0] for e in range(4)]
    return [min(NEVER, columns[e][s]) for s in range(4) for e in range(4)]


def labels(roles: list[str | None], state: int, end: list[int]) -> list[int]:
    """The label of each turn on the cheapest path."""
    go, out = costs_to_go(roles, end), []
    for k, role in enumerate(roles):
        state = min((cost + label_cost(role, label) + go[k + 1][label], label) for (s, label), (cost, _) in STEPS.items() if s == state)[1]
        out.append(state)
    return out


def safe(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


def opened(role: str) -> str:
    return f"{OPEN}{role}\n"


def repair(turns: list[tuple], state: int, message: int, position: int, end: list[int], last: bool):
    """Rows (conv_id, turn, role, text) of one stretch in order to rows of OUT. state, message, position: as the stretch begins."""
    roles = [named(t[2]) for t in turns]
    for (conv_id, turn, role, text), known, label in zip(turns, roles, labels(roles, state, end)):
        merged = state == label
        inserted = STEPS[state, label][1]
        action = "+".join(a for a, holds in (("merge", merged), ("relabel", known != ROLES[label - 1]), ("insert", bool(inserted))) if holds) or "keep"
        shown = "\n" if merged else (f"{CLOSE}\n" if message else "") + "".join(f"{opened(r)}{CLOSE}\n" for r in inserted) + opened(ROLES[label - 1])
        message += 0 if merged else 1 + len(inserted)
        yield [conv_id, turn, position, role, ROLES[label - 1], action, ",".join(inserted), message - 1, shown + safe(text)]
        state, position = label, position + 1


def closing(state: int) -> tuple[str, str]:
    """What ends a conversation: its text and the roles of inserted messages."""
    added = ENDS[state][1]
    return f"{CLOSE}\n" + "".join(f"{opened(r)}{CLOSE}\n" for r in added), ",".join(added)


def _stretches(batches, columns: int):
    """Runs of rows with equal (conv_id, stretch) of a sorted partition."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[: columns])):
            if held and (row[:2] != key or row[0] is None):
                yield held
                held = []
            key = row[:2]
            held.append(row)
    if held:
        yield held


def render(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: (conv_id, turn, position, role, final_role, action, inserted, message, rendered)."""
    source = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(2**53)).cast("long"))
    alone, source = source.filter("conv_id is null"), source.filter("conv_id is not null")
    long_ones = source.groupBy("conv_id").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high")).filter("low < high").select("conv_id")
    context = _contexts(source.select("conv_id", "stretch", "turn", "role", "text").join(long_ones, "conv_id", "left_semi"))
    rows = source.join(context, ["conv_id", "stretch"], "left").select("conv_id", "stretch", "turn", "role", "text", "state", "message", "position", "end", "last")

    def run(batches):
        for turns in _stretches(batches, 10):
            state, message, position, end, last = turns[0][5:]
            if end is None:
                state, message, position, end, last = 0, 0, 0, END, True
            done = list(repair([(t[0], t[2], t[3], t[4]) for t in turns], state, message, position, end, last))
            if last:
                text, added = closing(1 + ROLES.index(done[-1][4]))
                done[-1][8] += text
                done[-1][6] = ",".join(x for x in (done[-1][6], added) if x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _OUT.types)], schema=_OUT)

    # Rows that belong to no conversation stay where they are.
    alone = alone.select("conv_id", "stretch", "turn", "role", "text", *(F.lit(None).cast(context.schema[c].dataType).alias(c) for c in ("state", "message", "position", "end", "last")))
    return _sorted(rows).unionAll(alone).mapInArrow(run, OUT)


_OUT = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in OUT.split(", ")])


def _sorted(rows: DataFrame) -> DataFrame:
    order = ["conv_id", "stretch", F.col("turn").asc_nulls_last(), "role", "text"]
    return rows.repartition("conv_id", "stretch").sortWithinPartitions(*order)


def _contexts(turns: DataFrame) -> DataFrame:
    """(conv_id, stretch, state, message, position, end, last) of each stretch of the conversations that have several."""

    def matrices(batches):
        for rows in _stretches(batches, 5):
            yield pa.RecordBatch.from_pydict({"conv_id": [rows[0][0]], "stretch": [rows[0][1]], "turns": [len(rows)], "m": [matrix([named(r[3]) for r in rows])]}, schema=pa.schema([("conv_id", pa.int64()), ("stretch", pa.int64()), ("turns", pa.int64()), ("m", pa.list_(pa.int64()))]))

    ordered = _sorted(turns)
    small, _ = materialize(ordered.mapInArrow(matrices, "conv_id long, stretch long, turns long, m array<long>"), "chat-matrices")

    def backwards(found):
        found = found.sort_values("stretch", ascending=False)
        end, ends = np.array(END), []
        for m in found["m"]:
            ends.append(end.tolist())
            end = (np.asarray(m).reshape(4, 4) + end).min(axis=1)
        found["end"] = ends
        found["last"] = [True] + [False] * (len(found) - 1)
        found["position"] = found["turns"].to_numpy()[::-1].cumsum()[::-1] - found["turns"]
        return found[["conv_id", "stretch", "end", "last", "position"]]

    ends, _ = materialize(small.groupBy("conv_id").applyInPandas(backwards, "conv_id long, stretch long, end array<long>, last boolean, position long"), "chat-ends")

    def exits(batches):
        for rows in _stretches(batches, 6):
            roles, end = [named(r[3]) for r in rows], rows[0][5]
            states, made = [], []
            for state in range(4):
                path = labels(roles, state, end) if min(costs_to_go(roles, end)[0][state], NEVER) < NEVER else [0]
                states.append(path[-1])
                made.append(sum(1 + len(STEPS[a, b][1]) for a, b in zip([state, *path], path) if a != b) if path != [0] else 0)
            yield pa.RecordBatch.from_pydict({"conv_id": [rows[0][0]], "stretch": [rows[0][1]], "exits": [states], "made": [made]}, schema=pa.schema([("conv_id", pa.int64()), ("stretch", pa.int64()), ("exits", pa.list_(pa.int64())), ("made", pa.list_(pa.int64()))]))

    ways = _sorted(turns.join(ends.select("conv_id", "stretch", "end"), ["conv_id", "stretch"]).select("conv_id", "stretch", "turn", "role", "text", "end")).mapInArrow(exits, "conv_id long, stretch long, exits array<long>, made array<long>")

    def forwards(found):
        found = found.sort_values("stretch")
        state, message, states, messages = 0, 0, [], []
        for out, made in zip(found["exits"], found["made"]):
            states.append(state)
            messages.append(message)
            state, message = out[state], message + made[state]
        return found.assign(state=states, message=messages)[["conv_id", "stretch", "state", "message"]]

    starts = ways.groupBy("conv_id").applyInPandas(forwards, "conv_id long, stretch long, state long, message long")
    return materialize(starts.join(ends, ["conv_id", "stretch"]), "chat-contexts")[0]
