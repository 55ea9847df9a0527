"""Minimum-cost repair of chat roles, and rendering.

A legal conversation is one system message or none, then user and assistant in
turn, user first, assistant last. The automaton's state is the role of the last
message. Each turn takes a role (its own for nothing, another one for the cost
of a relabel) and either starts a message, with empty messages inserted where
the automaton has no direct way, or is merged into a last message of its role.
Dynamic programming over turns and states finds the cheapest way; of equally
cheap ones that with fewest messages, then the one that keeps most turns apart
from relabels and merges in the order of ``ACTIONS``.

On Spark conversations are sorted by ranges of (conv_id, turn, role, text), so
one that holds a large share of all rows lies in several ranges. A range's part
of a conversation acts on states as a matrix under (min, +). Only the first and
the last part of each range go to the driver, as matrices, which it chains to
find the states at the borders; then every range is repaired by itself. The
result is a row for each turn, whose rendered pieces, one after the other, are
the conversation, so no row grows with it.

Defined cases: roles are compared without case and spaces around them, and
``ALIASES`` are known; a null or unknown role takes any role for the cost of an
unknown one; null text is empty; rows without conv_id are one conversation;
null turns come first, and equal ones are in the order of role and text;
repeated rows are turns of their own; strings of the markers in a text are
broken by a space behind their "<", so that no text starts or ends a message;
a very long text is rendered whole, in its own row; further columns, whatever
their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
# Other names of roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
RELABEL, RELABEL_SYSTEM, UNKNOWN, MERGE, INSERT = 30, 25, 10, 12, 20
NEVER = 1 << 40
ACTIONS = ("keep", "relabel", "merge", "relabel+merge")
#: Roles inserted between a state and a new message of a role.
WAYS = {
    (START, SYSTEM): (),
    (START, USER): (),
    (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (),
    (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (),
    (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (),
    (ASSISTANT, ASSISTANT): (USER,),
}
#: What a conversation needs behind its last message.
ENDS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}

Best = tuple[int, int, int]  # cost, messages, rank of actions


def role_of(name: str | None) -> int | None:
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES[1:] else None


def relabel_cost(role: int | None, to: int) -> int:
    if role == to:
        return 0
    return UNKNOWN if role is None else RELABEL_SYSTEM if SYSTEM in (role, to) else RELABEL


def _moves() -> dict[int | None, list[tuple]]:
    """For each role of a turn: from, to, cost, messages, action, inserted."""
    out: dict[int | None, list[tuple]] = {}
    for role in (None, SYSTEM, USER, ASSISTANT):
        moves = []
        for to in (SYSTEM, USER, ASSISTANT):
            cost, changed = relabel_cost(role, to), role != to
            for (state, target), way in WAYS.items():
                if target == to:
                    moves.append((state, to, cost + INSERT * len(way), 1 + len(way), int(changed), way))
            moves.append((to, to, cost + MERGE, 0, 2 + changed, ()))
        out[role] = moves
    return out


MOVES = _moves()


def step(now: list[Best | None], role: int | None) -> tuple[list[Best | None], list[tuple | None]]:
    new: list[Best | None] = [None] * 4
    back: list[tuple | None] = [None] * 4
    for move in MOVES[role]:
        before = now[move[0]]
        if before is not None:
            found = before[0] + move[2], before[1] + move[3], before[2] + move[4]
            if new[move[1]] is None or found < new[move[1]]:
                new[move[1]], back[move[1]] = found, move
    return new, back


def matrix(roles: list[int | None]) -> list[list[Best | None]]:
    """From each state, the best way to each state over these turns."""
    out = []
    for entry in range(4):
        now: list[Best | None] = [None] * 4
        now[entry] = (0, 0, 0)
        for role in roles:
            now, _ = step(now, role)
        out.append(now)
    return out


def finish(now: list[Best | None]) -> int:
    """The state to end in, with what has to be inserted behind it."""
    ways = [(b[0] + INSERT * len(ENDS[s]), b[1] + len(ENDS[s]), b[2], s) for s, b in enumerate(now) if b is not None]
    return min(ways)[3]


def repair(roles: list[int | None], entry: int = START, end: int | None = None) -> list[tuple]:
    """The move of each turn: (from, to, cost, messages, action, inserted)."""
    now: list[Best | None] = [None] * 4
    now[entry], backs = (0, 0, 0), []
    for role in roles:
        now, back = step(now, role)
        backs.append(back)
    state, out = finish(now) if end is None else end, []
    for back in reversed(backs):
        out.append(back[state])
        state = back[state][0]
    return out[::-1]


def header(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


FOOTER, BETWEEN = "<|im_end|>\n", "\n\n"
MARKER = re.compile(r"<(?=\|im_(?:start|end)\|>)")


def harmless(text: str) -> str:
    """The text without a marker of messages."""
    return MARKER.sub("< ", text)


def pieces(moves: list[tuple], texts: list[str], messages: int, last: bool) -> Iterator[tuple]:
    """new_role, action, inserted, message, rendered of each turn. ``messages``
    come before the first turn; ``last``: the conversation ends here."""
    for k, ((state, to, _, added, action, way), text) in enumerate(zip(moves, texts, strict=True)):
        messages, text = messages + added, harmless(text)
        if added:
            shown = (FOOTER if state != START else "") + "".join(header(r) + FOOTER for r in way) + header(to) + text
        else:
            shown = BETWEEN + text
        behind: tuple = ()
        if last and k == len(moves) - 1:
            behind = ENDS[to]
            shown += FOOTER + "".join(header(r) + FOOTER for r in behind)
        yield ROLES[to], ACTIONS[action], ",".join(ROLES[r] for r in way), ",".join(ROLES[r] for r in behind), messages - 1, shown


def chain(parts: list[dict]) -> dict[tuple[int, int], tuple[int, int, int, bool, bool]]:
    """parts: of each range in order its first and, if another, last
    conversation, {part, side, conv, ways}. Entry, exit, messages before, and
    whether it begins and ends here, for those that lie in several ranges."""
    runs: list[list[dict]] = []
    for x in parts:
        if runs and runs[-1][-1]["conv"] == x["conv"] and runs[-1][-1]["part"] != x["part"]:
            runs[-1].append(x)
        else:
            runs.append([x])
    plan = {}
    for run in runs:
        if len(run) == 1:
            continue
        now: list[Best | None] = [(0, 0, 0), None, None, None]
        froms = []
        for x in run:
            new: list[Best | None] = [None] * 4
            back = [START] * 4
            for s, b in enumerate(now):
                for t, w in enumerate(x["ways"][s]):
                    if b is not None and w is not None and (new[t] is None or (b[0] + w[0], b[1] + w[1], b[2] + w[2]) < new[t]):
                        new[t], back[t] = (b[0] + w[0], b[1] + w[1], b[2] + w[2]), s
            now = new
            froms.append(back)
        state, states = finish(now), []
        for back in reversed(froms):
            states.append((back[state], state))
            state = back[state]
        before = 0
        for k, (x, (a, b)) in enumerate(zip(run, reversed(states), strict=True)):
            plan[x["part"], x["side"]] = a, b, before, k == 0, k == len(run) - 1
            before += x["ways"][a][b][1]
    return plan


SCHEMA = "conv_id long, place long, turn long, role string, new_role string, action string, inserted string, inserted_after string, message long, rendered string"
_FIELDS = [("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.string()), ("inserted_after", pa.string()), ("message", pa.int64()), ("rendered", pa.string())]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], bool, bool]]:
    """Part, rows, and whether a conversation is the first or last of its part."""
    held: list[tuple] = []
    first = True
    for batch in batches:
        for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and (r[0] != held[-1][0] or r[1] != held[-1][1]):
                yield held[0][0], held, first, r[0] != held[-1][0]
                first, held = r[0] != held[-1][0], []
            held.append(r)
    if held:
        yield held[0][0], held, first, True


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, place (in the order of ``place`` the rendered
    pieces are the conversation), turn, role, new_role, action, inserted (roles
    of empty messages before it), inserted_after (behind the last one), message
    (from 0) and rendered."""
    picked = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = picked.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.select(F.spark_partition_id().alias("part"), "conv_id", F.monotonically_increasing_id().alias("at"), "turn", "role", "text")
    table = materialize(numbered, "turns")

    def dealt(*columns: str) -> DataFrame:
        return table.select("part", "conv_id", "at", *columns).repartition("part").sortWithinPartitions("part", "at")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, turns, first, last in _conversations(batches):
            if first or last:
                ways = [v for line in matrix([role_of(t[3]) for t in turns]) for b in line for v in (b or (NEVER, 0, 0))]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0 if first else 1], pa.int32()), pa.array([turns[0][1]], pa.int64()), pa.array([ways], pa.list_(pa.int64()))], ["part", "side", "conv", "ways"])

    found = dealt("role").mapInArrow(edges, "part int, side int, conv long, ways array<long>").collect()  # two rows for each range
    parts = []
    for r in sorted(found, key=lambda r: (r.part, r.side)):
        best = [tuple(r.ways[i : i + 3]) for i in range(0, 48, 3)]
        lines = [[None if b[0] >= NEVER else b for b in best[i : i + 4]] for i in range(0, 16, 4)]
        parts.append({"part": r.part, "side": r.side, "conv": r.conv, "ways": lines})
    plan = chain(parts)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])

        for part, turns, first, last in _conversations(batches):
            spans = plan.get((part, 0)) if first else plan.get((part, 1)) if last else None
            entry, end, before, _, ends = spans or (START, None, 0, True, True)
            moves = repair([role_of(t[4]) for t in turns], entry, end)
            done = pieces(moves, [t[5] or "" for t in turns], before, ends)
            out += [(t[1], t[2], t[3], t[4], *p) for t, p in zip(turns, done, strict=True)]
            if len(out) > 4096:
                yield batch()
                out = []
        if out:
            yield batch()

    return dealt("turn", "role", "text").mapInArrow(render, SCHEMA)
