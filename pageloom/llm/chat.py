"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with assistant. Each turn is
given a role by dynamic programming over the automaton of legal turns: keeping its role is free, relabelling, merging
it into the turn before, or inserting an empty turn have a cost. Turns are dealt out by ranges of (conversation, turn)
and sorted, so a conversation may run over several tasks: each task first reports the cost of its first and last
conversation's piece between all states (a small min-plus matrix), the pieces are chained, and each task then repairs
its own turns between the states that it is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import cut

ROLES = ["system", "user", "assistant"]
START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, UNKNOWN, MERGE, INSERT = 8, 1, 2, 5
INF = 1 << 40
# Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Inserted empty turns between two states; None: no legal way. Equal states mean a merge.
BETWEEN = {
    (START, SYSTEM): [], (START, USER): [], (START, ASSISTANT): [USER], (SYSTEM, SYSTEM): [], (SYSTEM, USER): [], (SYSTEM, ASSISTANT): [USER],
    (USER, USER): [], (USER, ASSISTANT): [], (ASSISTANT, USER): [], (ASSISTANT, ASSISTANT): [],
}
#: Empty turns after the last one; a lone system turn is followed by both.
AT_END = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def role_state(role: str | None) -> int | None:
    return None if role is None else ALIASES.get(role.strip().lower())


def _step(state: int | None) -> np.ndarray:
    """Cost [before, after] of one turn whose given role is ``state``."""
    out = np.full((4, 4), INF, np.int64)
    for (p, q), between in BETWEEN.items():
        label = UNKNOWN if state is None else 0 if state == q else RELABEL
        out[p, q] = label + INSERT * len(between) + MERGE * (p == q)
    return out


STEPS = {s: _step(s) for s in (None, SYSTEM, USER, ASSISTANT)}
END_COST = np.array([INSERT * len(AT_END[s]) for s in range(4)])


def piece_costs(states: list[int | None]) -> np.ndarray:
    """Least cost between all states before and after a run of turns."""
    out = np.where(np.eye(4, dtype=bool), 0, INF).astype(np.int64)
    for s in states:
        out = np.minimum((out[:, :, None] + STEPS[s][None, :, :]).min(1), INF)
    return out


def repair(states: list[int | None], first: int = START, last: int | None = None) -> list[int]:
    """A cheapest role for each turn, from the state before the run to the one given after it (None: a legal end)."""
    cost, back = np.full(4, INF, np.int64), []
    cost[first] = 0
    for s in states:
        through = cost[:, None] + STEPS[s]
        back.append(through.argmin(0))
        cost = np.minimum(through.min(0), INF)
    at = int((cost + END_COST).argmin()) if last is None else last
    out = []
    for b in reversed(back):
        out.append(at)
        at = int(b[at])
    return out[::-1]


def plain(text: str | None) -> str:
    """A text that can't open or close a turn: the marks within it get a space."""
    return (text or "").replace("<|im_start|>", "<| im_start|>").replace("<|im_end|>", "<| im_end|>")


def render(text: str, before: int, role: int, last: bool) -> tuple[str, str]:
    """(piece of the rendered conversation, action): joined in order, the pieces of a conversation are its whole text."""
    if before == role:
        piece, action = "\n" + text, "merge"
    else:
        empty = "".join(f"{OPEN}{ROLES[x - 1]}\n{CLOSE}" for x in BETWEEN[before, role])
        piece = (CLOSE if before != START else "") + empty + f"{OPEN}{ROLES[role - 1]}\n{text}"
        action = "insert" if empty else "keep"
    if last:
        piece += CLOSE + "".join(f"{OPEN}{ROLES[x - 1]}\n{CLOSE}" for x in AT_END[role])
    return piece, action


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, role, new_role, action, piece, ends) for each row of conversations.

    action: keep, relabel, merge or insert (an empty turn comes before, whatever the label); ends: the last turn of its
    conversation. Turns are ordered by turn (null first), then role and text; rows of a null conv_id form one
    conversation; a null text is empty, and turn marks within a text are
    broken by a space, so that no text makes turns; null or unknown roles may become any role; repeated rows are turns of their own.
    """
    spark = conversations.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ranged = rows.repartitionByRange(*order, F.xxhash64(*order)).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("part", F.spark_partition_id()))
    columns = ["conv_id", "turn", "role", "text", "part"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, list[tuple]]]:
        """(part, conv_id, its rows in this part)."""
        at, own, part = None, [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if own and (row[0] != at or row[4] != part):
                    yield part, at, own
                    own = []
                at, part = row[0], row[4]
                own.append(row)
        if own:
            yield part, at, own

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for part, conv, own in runs(batches):
            piece = (part, conv, piece_costs([role_state(r[2]) for r in own]).reshape(-1).tolist(), len(own))
            first, last = first or piece, piece
        out = [] if first is None else [(*first, True, first is last), *([] if first is last else [(*last, False, True)])]
        if out:
            cols = list(zip(*out, strict=True))
            types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["part", "conv_id", "costs", "n", "is_first", "is_last"])

    found = placed.mapInArrow(edges, "part int, conv_id long, costs array<long>, n long, is_first boolean, is_last boolean")
    plan = spark.sparkContext.broadcast(_chain([tuple(r) for r in found.collect()]))  # two small matrices for each task

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pending: list[tuple] | None = None

        def emit(part, conv, own, is_last):
            keys = [(part, is_first) for is_first in ([True] if part not in seen else []) + ([False] if is_last else [])]
            given = next((plan.value[k] for k in keys if k in plan.value), (START, None, True, 0))
            seen.add(part)
            before, after, ends, skipped = given
            out = []
            for i, (row, role) in enumerate(zip(own, repair([role_state(r[2]) for r in own], before, after), strict=True)):
                last = ends and i == len(own) - 1
                piece, action = render(plain(row[3]), before, role, last)
                if action == "keep" and role_state(row[2]) != role:
                    action = "relabel"
                out.append((conv, row[1], skipped + i, row[2], ROLES[role - 1], action, piece, last))
                before = role
            cols = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "turn", "seq", "role", "new_role", "action", "piece", "ends"])

        for run in runs(batches):
            if pending is not None:
                yield emit(*pending, is_last=pending[0] != run[0])
            pending = run
        if pending is not None:
            yield emit(*pending, is_last=True)

    return placed.mapInArrow(write, "conv_id long, turn long, seq long, role string, new_role string, action string, piece string, ends boolean")


def _chain(pieces: list[tuple]) -> dict[tuple[int, bool], tuple[int, int | None, bool, int]]:
    """For pieces of conversations that run over tasks: (state before, state after, whether it ends here, turns before) by (part, is_first)."""
    pieces = sorted(pieces, key=lambda p: (p[0], not p[4]))
    out: dict[tuple[int, bool], tuple[int, int | None, bool, int]] = {}
    i = 0
    while i < len(pieces):
        j = i + 1
        while j < len(pieces) and pieces[j][1] == pieces[i][1] and pieces[j][0] != pieces[j - 1][0] and pieces[j - 1][5] and pieces[j][4]:
            j += 1
        group = pieces[i:j]
        if len(group) > 1:
            costs = [np.array(p[2], np.int64).reshape(4, 4) for p in group]
            entry, back = np.full(4, INF, np.int64), []
            entry[START] = 0
            for c in costs:
                through = entry[:, None] + c
                back.append(through.argmin(0))
                entry = np.minimum(through.min(0), INF)
            state = int((entry + END_COST).argmin())
            for k in range(len(group) - 1, -1, -1):
                before = int(back[k][state])
                out[group[k][0], bool(group[k][4])] = (before, state, k == len(group) - 1, sum(p[3] for p in group[:k]))
                state = before
        i = j
    return out
