"""Chat formatting: minimum-cost role repair over an automaton of legal turns, then rendering.

A conversation may begin with a system turn; then user and assistant turns alternate,
and it ends with an assistant turn. Dynamic programming chooses, turn by turn, whether
to keep, relabel, or merge a turn with the one before, and where to insert empty turns,
so that the whole sequence is legal at the least cost.

One turn is a min-plus matrix over the automaton's states, and a run of turns is their
product. The turns are range partitioned, so a conversation of any length lies in
successive partitions; each reports the matrices of the conversations that cross its
borders, the driver (two small matrices per partition) fixes the states at the borders,
and every partition traces its own best path between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import clear_names, ready_workers

ROLES = ("system", "user", "assistant")
#: Other names of roles (fixed values).
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "ai": "assistant", "model": "assistant"}
#: States are the roles of the last turn; START is before the first.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
RELABEL, UNKNOWN, MERGE, INSERT = 3.5, 0.5, 1.0, 2.0
#: Legal next turns.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MARKS = {"system": ("<|system|>\n", "<|end|>\n"), "user": ("<|user|>\n", "<|end|>\n"), "assistant": ("<|assistant|>\n", "<|end|>\n")}


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The empty turns to insert between two states so that the second is a legal new turn."""
    out = {}
    for s in range(STATES):
        for x in (SYSTEM, USER, ASSISTANT):
            if x in NEXT[s]:
                out[s, x] = ()
            else:
                ways = [(m,) for m in NEXT[s] if x in NEXT[m]] + [(m, k) for m in NEXT[s] for k in NEXT[m] if x in NEXT[k]]
                if ways:
                    out[s, x] = min(ways, key=lambda w: (len(w), w))
    return out


INSERTS = _paths()


def role_of(role: str | None) -> int:
    """The state of a role's name, 0 for an unknown one."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def step_matrix(role: int) -> tuple[np.ndarray, np.ndarray]:
    """Cost of going from state to state by one turn, and whether by merging."""
    cost = np.full((STATES, STATES), np.inf)
    merged = np.zeros((STATES, STATES), bool)
    for s in range(STATES):
        for x in (SYSTEM, USER, ASSISTANT):
            label = 0.0 if role == x else UNKNOWN if role == 0 else RELABEL
            ways = []
            if s == x:
                ways.append((MERGE + label, True))
            if (s, x) in INSERTS:
                ways.append((INSERT * len(INSERTS[s, x]) + label, False))
            if ways:
                cost[s, x], merged[s, x] = min(ways)
    return cost, merged


_STEP = [step_matrix(r) for r in range(STATES)]
#: Cost of ending in a state: an empty answer (and question) is added unless an assistant spoke last.
END = np.array([np.inf, 2 * INSERT, INSERT, 0.0])
END_INSERTS = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: (), START: ()}


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def run_matrix(roles: np.ndarray) -> np.ndarray:
    """Costs of a whole run of turns, by halving: few numpy calls for long runs."""
    if not len(roles):
        out = np.full((STATES, STATES), np.inf)
        np.fill_diagonal(out, 0.0)
        return out
    many = np.stack([c for c, _ in _STEP])[roles]
    while len(many) > 1:
        odd = many[-1:] if len(many) % 2 else many[:0]
        pairs = many[: len(many) // 2 * 2]
        many = np.concatenate([(pairs[0::2, :, :, None] + pairs[1::2, None, :, :]).min(axis=2), odd])
    return many[0]


def trace(roles: np.ndarray, begin: int, end: int | None) -> tuple[list[int], list[bool]]:
    """States after each turn of a cheapest way from ``begin`` to ``end`` (None: anywhere, with the end's cost), and merges.

    Among equal ways the smaller state is taken, from the last turn back.
    """
    cost = np.full(STATES, np.inf)
    cost[begin] = 0.0
    costs = [cost]
    for r in roles.tolist():
        cost = (cost[:, None] + _STEP[r][0]).min(axis=0)
        costs.append(cost)
    state = int(np.argmin(cost + END)) if end is None else end
    states, merges = [], []
    for t in range(len(roles) - 1, -1, -1):
        step, merged = _STEP[int(roles[t])]
        before = int(np.argmin(costs[t] + step[:, state]))
        states.append(state)
        merges.append(bool(merged[before, state]))
        state = before
    return states[::-1], merges[::-1]


def _runs(conv: list, roles: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of one conversation in sorted rows."""
    if not conv:
        return []
    cuts = [0, *[i for i in range(1, len(conv)) if conv[i] != conv[i - 1]], len(conv)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _whole(batches: Iterator[pa.RecordBatch], columns: list[str]) -> tuple[dict[str, list], int]:
    held: dict[str, list] = {c: [] for c in columns}
    for batch in batches:
        for c in columns:
            held[c] += batch[c].to_pylist()
    return held, len(held[columns[0]])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last conversation of a partition, with their matrices (one row if it has one conversation)."""
    held, n = _whole(batches, ["part", "conv_id", "role"])
    names = ["part", "at", "conv_id", "costs"]
    rows = []
    if n:
        roles = np.array([role_of(r) for r in held["role"]], int)
        runs = _runs(held["conv_id"], roles)
        for at, (lo, hi) in {0: runs[0], len(runs) - 1: runs[-1]}.items():
            rows.append((held["part"][0], 0 if at == 0 and len(runs) == 1 else 1 if at == 0 else 2, held["conv_id"][lo], run_matrix(roles[lo:hi]).ravel().tolist()))
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def border_states(rows: list[tuple[int, int, int | None, list[float]]]) -> dict[int, tuple[int, int | None]]:
    """For each partition: the state in which its first run begins, and in which its last must end (None: it ends here).

    ``at`` is 0 for the only run of a partition, 1 for its first and 2 for its last.
    """
    chains: list[list[tuple[int, int, np.ndarray]]] = []
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    for part, at, conv, costs in ordered:
        matrix = np.array(costs).reshape(STATES, STATES)
        crosses = at in (0, 1) and chains and chains[-1][-1][3] == conv and chains[-1][-1][1] in (0, 2) and chains[-1][-1][0] != part
        if crosses:
            chains[-1].append((part, at, matrix, conv))
        else:
            chains.append([(part, at, matrix, conv)])
    out: dict[int, list] = {r[0]: [START, None] for r in ordered}
    for chain in chains:
        cost = np.full(STATES, np.inf)
        cost[START] = 0.0
        costs = [cost]
        for _, _, matrix, _ in chain:
            cost = (cost[:, None] + matrix).min(axis=0)
            costs.append(cost)
        state = int(np.argmin(cost + END))
        last = len(chain) - 1
        for k in range(last, -1, -1):
            part, _, matrix, _ = chain[k]
            before = int(np.argmin(costs[k] + matrix[:, state]))
            if k < last:
                out[part][1] = state
            if k > 0:
                out[part][0] = before
            state = before
    return {k: (b, e) for k, (b, e) in out.items()}


_OUT = "conv_id bigint, turn bigint, role string, action string, inserted string, rendered string"


def _repaired(fixed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states_at, marks = fixed.value
        batches = list(batches)
        held, n = _whole(iter(batches), ["part", "conv_id", "role"])
        if not n:
            return
        roles = np.array([role_of(r) for r in held["role"]], int)
        runs = _runs(held["conv_id"], roles)
        begin, end = states_at.get(held["part"][0], (START, None))
        states, merges, before, closes, opens_next = [], [], [], [], []
        for k, (lo, hi) in enumerate(runs):
            first = begin if k == 0 else START
            goal = end if k == len(runs) - 1 else None
            s, m = trace(roles[lo:hi], first, goal)
            states += s
            merges += m
            before += [first, *s[:-1]]
            closes += [False] * (hi - lo - 1) + [goal is None]
        at = 0
        for batch in batches:
            columns = {c: [] for c in ("role", "action", "inserted", "rendered")}
            texts = batch["text"].to_pylist()
            for text in texts:
                state, merged, prior = states[at], merges[at], before[at]
                name = ROLES[state - 1]
                open_mark, close_mark = marks[name]
                empties = () if merged else INSERTS[prior, state]
                # The mark that closes a turn stands before the next one, since that may still be merged.
                lead = "\n" if merged else (marks[ROLES[prior - 1]][1] if prior != START else "") + "".join(
                    marks[ROLES[e - 1]][0] + marks[ROLES[e - 1]][1] for e in empties) + open_mark
                tail = ""
                added = [ROLES[e - 1] for e in empties]
                if closes[at]:
                    more = END_INSERTS[state]
                    tail = close_mark + "".join(marks[ROLES[e - 1]][0] + marks[ROLES[e - 1]][1] for e in more)
                    added += [ROLES[e - 1] for e in more]
                columns["role"].append(name)
                columns["action"].append(("merge" if merged else "keep") if roles[at] == state else "merge+relabel" if merged else "relabel")
                columns["inserted"].append(",".join(added))
                columns["rendered"].append(lead + (text or "") + tail)
                at += 1
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["turn"], *[pa.array(columns[c], pa.string()) for c in ("role", "action", "inserted", "rendered")]],
                names=["conv_id", "turn", "role", "action", "inserted", "rendered"])

    return run


def format_chats(turns: DataFrame, marks: dict[str, tuple[str, str]] | None = None, partitions: int | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, role (repaired), action, inserted, rendered.

    The ``rendered`` pieces of a conversation, joined in the order (turn, role, text), are
    its whole formatted text; ``inserted`` names the empty turns that a piece adds. Null
    turns come first, a null text is empty, an unknown or null role costs ``UNKNOWN``
    to label, rows with a null conv_id are one conversation, repeated rows are turns of
    their own, and an empty table gives no rows. Other columns are not read.
    """
    spark = turns.sparkSession
    ready_workers(spark)
    plain = clear_names(turns, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = ["conv_id", "turn", "role", "text"]
    # The last key only spreads rows that are equal in all columns.
    spread = plain.withColumn("tie", F.monotonically_increasing_id())
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = spread.repartitionByRange(n, *order, "tie").sortWithinPartitions(*order, "tie")
    # Both passes must see the same partitions.
    fixed_rows = cut_lineage(ranged.select(F.spark_partition_id().alias("part"), *order))
    found = fixed_rows.select("part", "conv_id", "role").mapInArrow(_borders, "part int, at int, conv_id bigint, costs array<double>").collect()
    states = border_states([tuple(r) for r in found])
    fixed = spark.sparkContext.broadcast((states, marks or MARKS))
    return fixed_rows.mapInArrow(_repaired(fixed), _OUT)
