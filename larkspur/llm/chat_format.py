"""Chat formatting by minimum-cost role repair.

Legal conversations are: at most one system turn at the start, then user and assistant in turn, the user first, the assistant last.
A dynamic program over this automaton's states repairs a conversation at least cost: a turn may be merged into the turn before (MERGE), be
given another role (RELABEL), or have an empty turn put before it (INSERT). Each row of the result is a turn, or an
inserted empty one, with its piece of the rendered text; the pieces of a conversation in order are its rendering.

Turns are dealt out by range of (conversation, turn), so one conversation may lie in many tasks. A task sums up its part
of such a conversation as the costs from each state to each other; composing these gives every part the costs it starts with, and the
way back gives every part the state it must end in. Only these few numbers, two parts for a task at most, come to the driver. The dynamic program
reads roles alone; texts are joined to its steps and rendered row by row, however long they are.
"""

from __future__ import annotations

import pyarrow as pa
from larkspur.llm.store import cut, partitions
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGE, INSERT, RELABEL = 1, 2, 3
#: States: nothing yet, and after a turn of each role.
ROLES = (None, "system", "user", "assistant")
_LEGAL = {(0, 1), (0, 2), (1, 2), (3, 2), (2, 3)}
_FAR = 1 << 60
#: How a conversation ends from each state: cost and the roles inserted.
_END = ((0, ()), (2 * INSERT, (2, 3)), (INSERT, (3,)), (0, ()))


def _options(role: int) -> list[tuple[int, int, int, str, int]]:
    """(from, to, cost, action, inserted role) for a turn, in the order in which equal costs are preferred."""
    out = []
    for s in range(4):
        for t in (1, 2, 3):
            change = 0 if t == role else RELABEL
            word = "" if t == role else "relabel "
            if (s, t) in _LEGAL:
                out.append((s, t, change, word + "keep", 0))
            if s == t:
                out.append((s, t, change + MERGE, word + "merge", 0))
            for x in (2, 3):
                if (s, x) in _LEGAL and (x, t) in _LEGAL:
                    out.append((s, t, change + INSERT, word + "insert", x))
    return sorted(out, key=lambda o: o[2])


_OPTIONS = {r: _options(r) for r in range(4)}


def role_number(role: str | None) -> int:
    """0 for a role that is null or unknown, which only a relabel can make legal."""
    return ROLES.index(role) if role in ROLES[1:] else 0


def forward(roles: list[int], start: list[int]) -> tuple[list[int], list[list[tuple | None]]]:
    """Costs of the states after the turns, and for each turn the option that leads to each state at least cost."""
    cost, back = list(start), []
    for role in roles:
        new, via = [_FAR] * 4, [None] * 4
        for o in _OPTIONS[role]:
            c = cost[o[0]] + o[2]
            if c < new[o[1]]:
                new[o[1]], via[o[1]] = c, o
        cost = new
        back.append(via)
    return cost, back


def trace(back: list[list[tuple | None]], end: int) -> list[tuple]:
    path = []
    for via in reversed(back):
        path.append(via[end])
        end = via[end][0]
    return path[::-1]


def best_end(cost: list[int]) -> int:
    return min(range(4), key=lambda s: (min(cost[s], _FAR) + _END[s][0], s))


def repair(roles: list[int]) -> tuple[int, list[tuple], tuple[int, ...]]:
    """Least cost, the option taken for each turn, and the roles inserted at the end."""
    cost, back = forward(roles, [0, _FAR, _FAR, _FAR])
    end = best_end(cost)
    return cost[end] + _END[end][0], trace(back, end), _END[end][1]


def _open(role: int, text: str) -> str:
    return f"<|{ROLES[role]}|>\n{text}"


_CLOSE = "<|end|>\n"


def pieces(path: list[tuple], texts: list[str | None], extra: tuple[int, ...]):
    """(index of the turn or None, state, action, piece of the rendering) in order."""
    for i, (option, text) in enumerate(zip(path, texts)):
        came, state, _, action, inserted = option
        text = text or ""
        if action.endswith("merge"):
            yield i, state, action, "\n\n" + text
            continue
        before = _CLOSE if came else ""
        if inserted:
            yield None, inserted, "inserted", before + _open(inserted, "")
            before = _CLOSE
        yield i, state, action, before + _open(state, text)
    for role in extra:
        yield None, role, "inserted", _CLOSE + _open(role, "")


def format_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, turn, step, role, action, piece): one row per turn and per inserted turn (turn is null there).

    step orders the rows of a conversation. Turns are ordered by number (null first), then role and text, so repeated turns have a
    fixed order. A null text is empty; a null or unknown role is relabelled; rows with a null conversation form one
    conversation. Rows repeated whole are turns of their own. Other columns are not read, whatever their names. The rendering is the pieces
    in order, and after the last of them the closing mark.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text")
    )
    order = ["conv", "turn", "role", "text"]
    dealt = rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    schema = rows.select("*").schema.add("part", "integer").add("pos", "long")

    def number(batches):
        part, pos = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(pos, pos + n), pa.int64())], names=schema.names)
            pos += n

    dealt = cut(dealt.mapInArrow(number, schema))
    narrow = dealt.select("part", "pos", F.xxhash64("conv", F.isnull("conv")).alias("conv"), "role")

    def runs(rows: pa.Table):
        """The part's number, and (conversation, first, last) of each run in it, in order."""
        rows = rows.sort_by("pos")
        conv = rows.column("conv").to_pylist()
        cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
        return rows, rows.column("part")[0].as_py(), [(conv[a], a, b) for a, b in zip(cuts, cuts[1:])]

    def costs(rows: pa.Table) -> pa.Table:
        rows, part, found = runs(rows)
        role, out = [role_number(r) for r in rows.column("role").to_pylist()], []
        for k in sorted({0, len(found) - 1}):
            conv, a, b = found[k]
            out.append((part, k, conv, [c for s in range(4) for c in forward(role[a:b], [0 if s == t else _FAR for t in range(4)])[0]]))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "run", "conv", "cost"), zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))})

    edges = sorted(tuple(r) for r in narrow.groupBy("part").applyInArrow(costs, "part int, run int, conv long, cost array<long>").collect())
    start, chains = {}, []
    for part, run, conv, cost in edges:
        if chains and chains[-1][-1][2] == conv:
            came, last = start[chains[-1][-1][:2]], chains[-1][-1][3]
            start[part, run] = [min(min(came[s] + last[4 * s + t] for s in range(4)), _FAR) for t in range(4)]
            chains[-1].append((part, run, conv, cost))
        else:
            start[part, run] = [0, _FAR, _FAR, _FAR]
            chains.append([(part, run, conv, cost)])
    chains = [c for c in chains if len(c) > 1]
    split = {x[:2] for c in chains for x in c}
    start = {k: v for k, v in start.items() if k in split}

    def ways_back(rows: pa.Table) -> pa.Table:
        rows, part, found = runs(rows)
        role, out = [role_number(r) for r in rows.column("role").to_pylist()], []
        for k, (_, a, b) in enumerate(found):
            if (part, k) in start:
                cost, back = forward(role[a:b], start[part, k])
                out.append((part, k, [trace(back, t)[0][0] if cost[t] < _FAR else -1 for t in range(4)], cost))
        names, types = ("part", "run", "came", "cost"), (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(zip(names, types))})

    target: dict[tuple[int, int], int] = {}
    if split:
        held = narrow.where(F.col("part").isin(sorted({p for p, _ in split})))
        found = {(r["part"], r["run"]): r for r in held.groupBy("part").applyInArrow(ways_back, "part int, run int, came array<long>, cost array<long>").collect()}
        for chain in chains:
            end = best_end(found[chain[-1][:2]]["cost"])
            for part, run, *_ in reversed(chain):
                target[part, run] = end
                end = found[part, run]["came"][end]
    last = {c[-1][:2] for c in chains}

    def steps(rows: pa.Table) -> pa.Table:
        """What happens to each turn: the state before it and its own, the action, the role inserted before it, the roles inserted after it."""
        rows, part, found = runs(rows)
        pos, role, out = rows.column("pos").to_pylist(), [role_number(r) for r in rows.column("role").to_pylist()], []
        for k, (_, a, b) in enumerate(found):
            cost, back = forward(role[a:b], start.get((part, k), [0, _FAR, _FAR, _FAR]))
            end = target.get((part, k), best_end(cost))
            extra = _END[end][1] if (part, k) not in target or (part, k) in last else ()
            for i, (came, state, _, action, inserted) in enumerate(trace(back, end), a):
                out.append((part, pos[i], came, state, action, inserted, extra if i == b - 1 else ()))
        types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "pos", "came", "state", "action", "inserted", "extra"), zip(*out), types)})

    plan = cut(narrow.groupBy("part").applyInArrow(steps, "part int, pos long, came int, state int, action string, inserted int, extra array<int>"))
    return _rendered(dealt.join(plan, ["part", "pos"]))


def _rendered(turns: DataFrame) -> DataFrame:
    """The rows of pieces(), by expressions on one turn at a time: texts meet no Python and no task gathers them."""
    names = F.array(*(F.lit(r) for r in ROLES[1:]))
    role = lambda state: F.element_at(names, state)
    opened = lambda state, text: F.concat(F.lit("<|"), role(state), F.lit("|>\n"), text)
    row = lambda turn, k, state, action, piece: F.struct(turn.alias("turn"), k.cast("long").alias("k"), role(state).alias("role"), action.alias("action"), piece.alias("piece"))
    none, inserted = F.lit(None).cast("long"), F.lit("inserted")
    text, closed = F.coalesce("text", F.lit("")), F.when(F.col("came") > 0, F.lit(_CLOSE)).otherwise(F.lit(""))
    before = F.when(F.col("inserted") > 0, F.lit(_CLOSE)).otherwise(closed)
    piece = F.when(F.col("action").endswith("merge"), F.concat(F.lit("\n\n"), text)).otherwise(F.concat(before, opened(F.col("state"), text)))
    ahead = row(none, F.lit(0), F.greatest("inserted", F.lit(1)), inserted, F.concat(closed, opened(F.greatest("inserted", F.lit(1)), F.lit(""))))
    own = row(F.col("turn"), F.lit(1), F.col("state"), F.col("action"), piece)
    after = F.transform("extra", lambda x, i: row(none, 2 + i, x, inserted, F.concat(F.lit(_CLOSE), opened(x, F.lit("")))))
    every = F.concat(F.when(F.col("inserted") > 0, F.array(ahead, own)).otherwise(F.array(own)), after)
    step = F.shiftleft(F.col("part").cast("long"), 40) + 4 * F.col("pos")
    turns = turns.select("conv", step.alias("step"), F.explode(every).alias("x"))
    return turns.select("conv", "x.turn", (F.col("step") + F.col("x.k")).alias("step"), "x.role", "x.action", "x.piece")


def query(spark, sf_dir):
    out = format_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumnRenamed("conv", "conv_id")
