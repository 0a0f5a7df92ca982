"""Chat formatting with least-cost role repair.

A legal conversation is an optional system turn and then user and assistant turns in alternation, an assistant turn
last. For each conversation, dynamic programming over the states of that automaton finds the cheapest repair: turns
may be merged into the one before, relabelled, or preceded by empty turns. Steps are 4 x 4 matrices under (min, +),
whose product is associative, so a conversation is cut into chunks of CHUNK turns: chunks give matrices, the matrices
of a conversation give each chunk's entry and exit state, and chunks are then repaired on their own. No task holds a
whole conversation, however long.

Ties go to the lower state on the way back from the end. Turns are taken by turn number, then role and text; repeated
rows are turns of their own. Null roles and unknown ones may be anything, at a relabel's cost; null texts are empty;
a null conv_id is a conversation like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import materialize

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
ALIASES = {"human": USER, "prompter": USER, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT, "developer": SYSTEM} | {r: k for k, r in enumerate(ROLES) if r}
MERGE, RELABEL, INSERT = 1, 3, 2
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
FAR = 1 << 40
CHUNK = 4096


def _between() -> dict[tuple[int, int], list[int]]:
    """The shortest list of empty turns between two states; none where it is impossible."""
    out: dict[tuple[int, int], list[int]] = {}
    for a in range(4):
        ways = [(a, [])]
        for at, path in ways:
            for b in range(1, 4):
                if (at, b) in LEGAL and (a, b) not in out:
                    out[a, b] = path
                    ways.append((b, [*path, b]))
    return out


BETWEEN = _between()


def _step(role: int | None) -> tuple[np.ndarray, list[list[bool]]]:
    """Costs of going from each state to each by a turn of this role, and whether it is by a merge."""
    costs, merges = np.full((4, 4), FAR, dtype=np.int64), [[False] * 4 for _ in range(4)]
    for a in range(4):
        for b in range(1, 4):
            label = 0 if role == b else RELABEL
            fresh = INSERT * len(BETWEEN[a, b]) if (a, b) in BETWEEN else FAR
            merge = MERGE if a == b else FAR
            costs[a, b] = min(FAR, label + min(fresh, merge))
            merges[a][b] = merge <= fresh
    return costs, merges


STEPS = {r: _step(r) for r in (None, SYSTEM, USER, ASSISTANT)}
#: Cost of ending after each state: the empty turns that lead to an assistant turn.
ENDS = np.array([0] + [0 if s == ASSISTANT else INSERT * (len(BETWEEN[s, ASSISTANT]) + 1) for s in (SYSTEM, USER, ASSISTANT)], dtype=np.int64)


def role_number(role: str | None) -> int | None:
    return ALIASES.get((role or "").strip().lower())


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def path(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """States before, between and after the steps, on the cheapest way."""
    cost, costs = np.full(4, FAR, dtype=np.int64), []
    cost[first] = 0
    for m in matrices:
        costs.append(cost)
        cost = (cost[:, None] + m).min(axis=0)
    states = [last]
    for before, m in zip(reversed(costs), reversed(matrices), strict=True):
        states.append(int(np.argmin(before + m[:, states[-1]])))
    return states[::-1]




def _chunk_matrix(rows: pa.Table) -> pa.Table:
    roles = [role_number(r) for r in rows.sort_by("seq").column("role").to_pylist()]
    total = STEPS[roles[0]][0]
    for r in roles[1:]:
        total = times(total, STEPS[r][0])
    return pa.table([rows.column("conv_id")[:1], rows.column("chunk")[:1], pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=["conv_id", "chunk", "matrix"])


def _chunk_states(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("chunk")
    matrices = [np.array(m, dtype=np.int64).reshape(4, 4) for m in rows.column("matrix").to_pylist()]
    cost = np.full(4, FAR, dtype=np.int64)
    cost[START] = 0
    for m in matrices:
        cost = (cost[:, None] + m).min(axis=0)
    states = path(matrices, START, int(np.argmin(cost + ENDS)))
    last = [k == len(matrices) - 1 for k in range(len(matrices))]
    total = int((cost + ENDS).min())
    return pa.table([rows.column("conv_id"), rows.column("chunk"), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32()), pa.array(last), pa.array([total] * len(last), pa.int64())], names=["conv_id", "chunk", "entry", "exit", "last", "cost"])


def _repaired(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("seq")
    roles = [role_number(r) for r in rows.column("role").to_pylist()]
    states = path([STEPS[r][0] for r in roles], rows.column("entry")[0].as_py(), rows.column("exit")[0].as_py())
    close, opened = "<|end|>\n", lambda s: f"<|{ROLES[s]}|>\n"
    out = {"out_role": [], "action": [], "inserted": [], "piece": []}
    for k, (role, a, b, text) in enumerate(zip(roles, states, states[1:], rows.column("text").to_pylist(), strict=False)):
        merge = STEPS[role][1][a][b]
        empty = [] if merge else BETWEEN[a, b]
        head = "\n" if merge else (close if a != START else "") + "".join(opened(s) + close for s in empty) + opened(b)
        tail, after = "", []
        if k == len(roles) - 1 and rows.column("last")[0].as_py():
            after = [] if b == ASSISTANT else [*BETWEEN[b, ASSISTANT], ASSISTANT]
            tail = close + "".join(opened(s) + close for s in after)
        out["out_role"].append(ROLES[b])
        out["action"].append(("merge" if merge else "keep") if role == b else ("merge and relabel" if merge else "relabel"))
        out["inserted"].append(len(empty) + len(after))
        out["piece"].append(head + (text or "") + tail)
    names = ["conv_id", "turn", "seq", "role"]
    columns = [rows.column(c) for c in names] + [pa.array(out["out_role"], pa.string()), pa.array(out["action"], pa.string()), pa.array(out["inserted"], pa.int32()), pa.array(out["piece"], pa.string()), rows.column("cost")]
    return pa.table(columns, names=[*names, *out, "cost"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, seq, role, out_role, action, inserted, piece and the conversation's cost, a row for each turn.

    The pieces of a conversation in the order of seq are its rendered text.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    # Range partitions put neighbours together; a long conversation spreads over several.
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "text"]
    placed = rows.repartitionByRange(*order[:4]).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("chunk", F.floor(F.col("seq") / CHUNK)), "turns")
    # Roles and matrices are few bytes but much work: a stated number of partitions is not made smaller for its bytes.
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roles = placed.select("conv_id", "chunk", "seq", "role").repartition(parts, "conv_id", "chunk")
    matrices = roles.groupBy("conv_id", "chunk").applyInArrow(_chunk_matrix, "conv_id long, chunk long, matrix array<long>")
    states = matrices.repartition(parts, "conv_id").groupBy("conv_id").applyInArrow(_chunk_states, "conv_id long, chunk long, entry int, exit int, last boolean, cost long")
    states = states.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "entry", "exit", "last", "cost")
    joined = placed.join(states, placed["conv_id"].eqNullSafe(F.col("c")) & (placed["chunk"] == F.col("k"))).drop("c", "k")
    schema = "conv_id long, turn long, seq long, role string, out_role string, action string, inserted int, piece string, cost long"
    return joined.groupBy("conv_id", "chunk").applyInArrow(_repaired, schema)
