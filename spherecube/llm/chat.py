"""Chat formatting with role repair of minimum cost.

Legal conversations: an optional system turn, then user and assistant in turn, an assistant turn last. Every given turn is
kept; it may be merged into the turn before it, get another role, or get empty turns inserted before it. Dynamic
programming over the automaton of legal turns finds the cheapest repair.

Turns are sorted over all conversations and cut into blocks of bounded size. A block yields, for each of its
conversations, the cheapest way from every state to every state; for conversations over several blocks these
are chained, which fixes the states at block bounds, and each block then finds its own part of the repair. So the longest
conversation is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spherecube.runtime import materialise

#: Roles in the order of preference among equal costs, and what each change costs.
ROLES = ("system", "user", "assistant")
MERGE, RELABEL, INSERT = 1, 2, 3
#: Turns of a block: 2 to this power.
BLOCK_BITS = 12

START = 0  # states: before the first turn, then the role of the last turn, counted from 1
#: Legal next states.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
LAST = 3
NEVER = float("inf")


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest states to insert between any two states."""
    out = {}
    for a in range(4):
        paths = {b: () for b in NEXT[a]}
        for _ in range(3):
            for b, way in list(paths.items()):
                for c in NEXT[b]:
                    if c not in paths or len(paths[c]) > len(way) + 1:
                        paths[c] = (*way, b)
        out.update({(a, b): way for b, way in paths.items()})
    return out


INSERTIONS = _insertions()


def moves(role: str | None) -> list[tuple[int, int, float, bool, tuple[int, ...]]]:
    """(from, to, cost, merged, inserted) for a turn of this role; roles that are not known are relabelled."""
    out = []
    for to, name in enumerate(ROLES, 1):
        relabel = 0 if role == name else RELABEL
        for state in range(4):
            if state == to:
                out.append((state, to, relabel + MERGE, True, ()))
            elif (state, to) in INSERTIONS:
                way = INSERTIONS[state, to]
                out.append((state, to, relabel + INSERT * len(way), False, way))
    return out


MOVES = {r: moves(r) for r in (*ROLES, None)}


def _moves(role):
    return MOVES.get(role, MOVES[None])


def end_cost(state: int) -> float:
    """What it costs to end a conversation in `state`; nothing where there was no turn."""
    return 0 if state in (START, LAST) else INSERT * (len(INSERTIONS[state, LAST]) + 1)


def cheapest(roles: list[str | None]) -> list[list[float]]:
    """The least cost from every state before these turns to every state after them."""
    costs = [[0 if a == b else NEVER for b in range(4)] for a in range(4)]
    for role in roles:
        now = [[NEVER] * 4 for _ in range(4)]
        for state, to, cost, _, _ in _moves(role):
            for a in range(4):
                if costs[a][state] + cost < now[a][to]:
                    now[a][to] = costs[a][state] + cost
        costs = now
    return costs


def repair(roles: list[str | None], entry: int, leave: int) -> list[tuple[int, bool, tuple[int, ...], int]]:
    """The cheapest repair between two states: per turn (state, merged, inserted before it, state before)."""
    costs, back = [0 if s == entry else NEVER for s in range(4)], []
    for role in roles:
        now, how = [NEVER] * 4, [None] * 4
        for state, to, cost, merged, way in _moves(role):
            if costs[state] + cost < now[to]:
                now[to], how[to] = costs[state] + cost, (state, merged, way)
        costs = now
        back.append(how)
    out, state = [], leave
    for how in reversed(back):
        before, merged, way = how[state]
        out.append((state, merged, way, before))
        state = before
    return out[::-1]


def bounds(matrices: list[list[list[float]]]) -> list[tuple[int, int]]:
    """The states before and after each block of one conversation, on its cheapest repair."""
    costs, back = [0, NEVER, NEVER, NEVER], []
    for m in matrices:
        how = [min(range(4), key=lambda a, b=b: costs[a] + m[a][b]) for b in range(4)]
        costs = [costs[how[b]] + m[how[b]][b] for b in range(4)]
        back.append(how)
    state, out = min(range(4), key=lambda s: costs[s] + end_cost(s)), []
    for how in reversed(back):
        out.append((how[state], state))
        state = how[state]
    return out[::-1]


def opening(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


CLOSING = "<|end|>\n"


def _groups(keys: list) -> list[tuple[int, int]]:
    """Runs of equal keys."""
    starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
    return list(zip(starts, [*starts[1:], len(keys)], strict=True))


def _sorted_turns(turns: DataFrame) -> DataFrame:
    """The turns in global order, with their places; partitions are cut anywhere, also within a conversation."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = ordered.withColumn("place", F.monotonically_increasing_id())
    return materialise(ordered.withColumn("block", F.shiftright("place", BLOCK_BITS)))


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, new_role, action, inserted, rendered for each row of `turns` (conv_id, turn, role, text).

    Rows are ordered by turn, then role and text, nulls first, and `place` numbers them in that order; the `rendered`
    strings of a conversation, put together by place, are the repaired conversation. action: kept, merged, relabelled or
    both ("relabelled,merged"); inserted: roles of the empty turns that stand before the turn. Unknown and null roles
    are relabelled; a null text is an empty one; repeated rows are turns like any other; rows of null conv_id are one
    conversation. Other columns are not looked at.
    """
    ordered = _sorted_turns(turns)

    def costs(table: pa.Table) -> pa.Table:
        rows = table.select(["conv_id", "block", "place", "role"]).sort_by("place")
        convs, roles = rows["conv_id"].to_pylist(), rows["role"].to_pylist()
        out = [(convs[a], cheapest(roles[a:b])) for a, b in _groups(convs)]
        flat = [[None if x == NEVER else float(x) for line in m for x in line] for _, m in out]
        block = rows["block"][0].as_py()
        return pa.table({"conv_id": pa.array([c for c, _ in out], pa.int64()), "block": pa.array([block] * len(out), pa.int64()), "costs": pa.array(flat, pa.list_(pa.float64()))})

    steps = materialise(ordered.select("conv_id", "block", "place", "role").groupBy("block").applyInArrow(costs, "conv_id long, block long, costs array<double>"))

    def chain(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block")
        square = [[[NEVER if x is None else x for x in m[4 * a : 4 * a + 4]] for a in range(4)] for m in rows["costs"].to_pylist()]
        convs, found = rows["conv_id"].to_pylist(), []
        order = sorted(range(len(convs)), key=lambda k: (convs[k] is None, convs[k] or 0))  # stable: by block within
        entry, leave, final = [0] * len(convs), [0] * len(convs), [False] * len(convs)
        for a, b in _groups([convs[k] for k in order]):
            found = bounds([square[k] for k in order[a:b]])
            for k, (e, s) in zip(order[a:b], found, strict=True):
                entry[k], leave[k] = e, s
            final[order[b - 1]] = True
        return pa.table({"conv_id": rows["conv_id"], "block": rows["block"], "entry": pa.array(entry, pa.int32()), "leave": pa.array(leave, pa.int32()), "final": pa.array(final)})

    # Conversations are chained in groups by hash; a group holds a row per conversation and block, not per turn.
    groups = F.pmod(F.xxhash64("conv_id"), F.greatest(F.lit(1), F.ceil(F.lit(steps.count()) / 5000)))
    joints = steps.withColumn("part", groups).groupBy("part").applyInArrow(
        lambda t: chain(t.drop(["part"])), "conv_id long, block long, entry int, leave int, final boolean"
    )
    joints = materialise(joints)

    def render(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.sort_by("place")
        states = {c: (e, s, f) for c, e, s, f in zip(*(right[n].to_pylist() for n in ("conv_id", "entry", "leave", "final")), strict=True)}
        convs, roles, texts = (rows[n].to_pylist() for n in ("conv_id", "role", "text"))
        new, action, inserted, rendered = [], [], [], []
        for a, b in _groups(convs):
            entry, leave, final = states[convs[a]]
            for k, (state, merged, way, before) in zip(range(a, b), repair(roles[a:b], entry, leave), strict=True):
                text = texts[k] or ""
                if merged:
                    piece = "\n\n" + text
                else:
                    piece = (CLOSING if before != START else "") + "".join(opening(s) + CLOSING for s in way) + opening(state) + text
                if final and k == b - 1:
                    piece += CLOSING
                    if state != LAST:
                        piece += "".join(opening(s) + CLOSING for s in (*INSERTIONS[state, LAST], LAST))
                new.append(ROLES[state - 1])
                done = ["relabelled"] * (roles[k] != new[-1]) + ["merged"] * merged
                action.append(",".join(done) or "kept")
                inserted.append([ROLES[s - 1] for s in way])
                rendered.append(piece)
        return pa.table({
            "conv_id": rows["conv_id"], "place": rows["place"], "turn": rows["turn"], "role": rows["role"],
            "new_role": pa.array(new, pa.string()), "action": pa.array(action, pa.string()), "inserted": pa.array(inserted, pa.list_(pa.string())), "rendered": pa.array(rendered, pa.string()),
        })

    schema = "conv_id long, place long, turn long, role string, new_role string, action string, inserted array<string>, rendered string"
    return ordered.groupBy("block").cogroup(joints.groupBy("block")).applyInArrow(render, schema)
