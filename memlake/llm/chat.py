"""Chat formatting: the cheapest repair of a conversation's roles, by dynamic programming, and its rendering.

Legal turns are an automaton: an optional system turn, then user and assistant in alternation, the assistant last.
Each message in order is kept, relabelled, merged into the turn before it, or preceded by inserted empty turns, and the
end may need empty turns too.  Costs: relabelling 4 (2 if the role is unknown or null), merging 1 (3 if unknown, 5
into another role), inserting 3.  Of repairs that cost
the same one is chosen, always the same for the same segments.

Conversations are sorted over range partitions and cut into segments of at most SEGMENT messages, so that one with a
third of all rows is shared out: each segment has its min-plus matrix of costs between automaton states, the matrices
of a conversation of several segments are chained (one row of 16 numbers for SEGMENT messages), and the segments are
then solved between the states found.  Texts move once, to meet their decisions.

The result has a row for each piece (a message or an inserted turn), in the order (seq, sub); a conversation is
its pieces' `rendered` concatenated.  Order within a conversation: turn (null first), then input order, so ties and
repeated rows are distinct messages.  Null texts render as empty; a null conv_id is a conversation.  Marks in texts are
defused.  Roles are trimmed and lower-cased, and common names for them understood.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import table, written

ROLES = ("system", "user", "assistant")
ALIASES = {"system": 0, "developer": 0, "user": 1, "human": 1, "prompter": 1, "assistant": 2, "bot": 2, "gpt": 2, "model": 2, "ai": 2}
UNKNOWN = 3
START, END = 0, 3  # states: 0 before the first turn, 1 + role after a turn
NEXT = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
RELABEL, RELABEL_UNKNOWN, MERGE, MERGE_UNKNOWN, INSERT = 4, 2, 1, 3, 3
SEGMENT = 4096
STATES = range(4)


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest run of inserted roles (possibly none) from each state to each that it reaches."""
    out = {(s, s): () for s in STATES}
    for _ in STATES:
        for (a, b), roles in list(out.items()):
            for r in NEXT[b]:
                if len(out.get((a, r + 1), range(9))) > len(roles) + 1:
                    out[a, r + 1] = (*roles, r)
    return out


INSERTIONS = _insertions()


def _moves(role: int, state: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(cost, next state, operation, insertions): the cheapest way to each next state."""
    best: dict[int, tuple] = {}
    for (a, mid), roles in INSERTIONS.items():
        if a != state:
            continue
        for r in NEXT[mid]:
            cost = INSERT * len(roles) + (0 if r == role else RELABEL_UNKNOWN if role == UNKNOWN else RELABEL)
            found = cost, r + 1, "keep" if r == role else "relabel", roles
            if r + 1 not in best or (cost, len(roles)) < (best[r + 1][0], len(best[r + 1][3])):
                best[r + 1] = found
    if state != START:
        cost = MERGE if role == state - 1 else MERGE_UNKNOWN if role == UNKNOWN else MERGE + RELABEL
        if state not in best or cost < best[state][0]:
            best[state] = cost, state, "merge" if role == state - 1 else "merge_relabel", ()
    return sorted(best.values())


MOVES = {(r, s): _moves(r, s) for r in range(4) for s in STATES}
FAR = 1 << 60


def solve(roles: list[int], begin: int, end: int | None) -> tuple[int, list[tuple[str, int, tuple[int, ...]]], tuple[int, ...]]:
    """Cost, (operation, role, insertions before) of each message, and insertions after the last.

    `end` is the state to reach; None is the end of the conversation, which inserts what is missing.
    """
    cost, back = [0 if s == begin else FAR for s in STATES], []
    for r in roles:
        new, choice = [FAR] * 4, [None] * 4
        for s in STATES:
            if cost[s] < FAR:
                for c, t, op, inserted in MOVES[r, s]:
                    if cost[s] + c < new[t]:
                        new[t], choice[t] = cost[s] + c, (s, op, inserted)
        cost = new
        back.append(choice)
    ends = [(cost[s] + INSERT * len(INSERTIONS[s, END]), s) for s in STATES] if end is None else [(cost[end], end)]
    total, state = min(ends)
    after = INSERTIONS[state, END] if end is None else ()
    out = []
    for choice in reversed(back):
        before, op, inserted = choice[state]
        out.append((op, state - 1, inserted))
        state = before
    return total, out[::-1], after


def matrix(roles: list[int]) -> list[int]:
    """Costs from each state (row) to each (column) over the messages."""
    out = []
    for begin in STATES:
        cost = [0 if s == begin else FAR for s in STATES]
        for r in roles:
            new = [FAR] * 4
            for s in STATES:
                for c, t, _, _ in MOVES[r, s]:
                    new[t] = min(new[t], cost[s] + c)
            cost = new
        out += [min(c, FAR) for c in cost]
    return out


def chain(matrices: list[list[int]]) -> list[tuple[int, int | None]]:
    """State before and after each segment of the cheapest repair; None after the last."""
    cost, back = [0 if s == START else FAR for s in STATES], []
    for m in matrices:
        step = [min((cost[a] + m[4 * a + b], a) for a in STATES) for b in STATES]
        cost = [min(c, FAR) for c, _ in step]
        back.append([a for _, a in step])
    state = min((cost[s] + INSERT * len(INSERTIONS[s, END]), s) for s in STATES)[1]
    states = [state]
    for choice in reversed(back):
        states.append(choice[states[-1]])
    states.reverse()
    return [(states[i], states[i + 1] if i + 1 < len(matrices) else None) for i in range(len(matrices))]


PIECE = "conv_id long, seg long, rid long, seq long, sub int, role int, op string, first boolean, last boolean"
_PIECE = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("rid", pa.int64()), ("seq", pa.int64()), ("sub", pa.int32()), ("role", pa.int32()), ("op", pa.string()), ("first", pa.bool_()), ("last", pa.bool_())])


def _pieces(conv, seg: int, rids: list[int], roles: list[int], begin: int, end: int | None, offset: int) -> list[tuple]:
    _, made, after = solve(roles, begin, end)
    out = []
    for i, (rid, (op, role, inserted)) in enumerate(zip(rids, made, strict=True)):
        out += [(conv, seg, None, offset + i, j, r, "insert") for j, r in enumerate(inserted)]
        out.append((conv, seg, rid, offset + i, len(inserted), role, op))
    out += [(conv, seg, None, offset + len(rids), j, r, "insert") for j, r in enumerate(after)]
    last = len(out) - 1
    return [(*p, begin == START and i == 0, end is None and i == last) for i, p in enumerate(out)]


def _segments(limit: int):
    """Sorted (conv_id, rid, role) to pieces, as if each segment were a conversation, and its heads (op "head")."""

    def run(batches):
        base, n, held, now = TaskContext.get().partitionId() << 32, 0, [], ()

        def flush():
            rids, roles = [r for r, _ in held], [c for _, c in held]
            return _pieces(now[0], base + n, rids, roles, START, None, 0), (now[0], base + n, len(held), matrix(roles), rids, roles)

        done, heads = [], []

        def batch():
            rows = [(*p, None, None, None, None) for p in done] + [(c, s, None, None, None, None, "head", None, None, size, m, rids, roles) for c, s, size, m, rids, roles in heads]
            kinds = [*_PIECE.types, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ((),) * 13, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=[*_PIECE.names, "size", "matrix", "rids", "roles"])

        for b in batches:
            for conv, rid, role in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (now != (conv,) or len(held) == limit):
                    p, h = flush()
                    done += p
                    heads.append(h)
                    held, n = [], n + 1
                now = (conv,)
                held.append((rid, role))
            if len(done) > 20_000:
                yield batch()
                done, heads = [], []
        if held:
            p, h = flush()
            done += p
            heads.append(h)
        yield batch()

    return run


def _chained(batches):
    """(segments of a conversation) to each segment's states and the number of messages before it."""
    for b in batches:
        rows = []
        for segments in b.column(0).to_pylist():
            segments.sort(key=lambda s: s["seg"])
            offsets = itertools.accumulate([0] + [s["size"] for s in segments[:-1]])
            rows += [(s["seg"], begin, end, offset) for s, (begin, end), offset in zip(segments, chain([s["matrix"] for s in segments]), offsets, strict=True)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ((),) * 4, kinds, strict=True)], names=["seg", "begin", "end", "offset"])


def _resolved(batches):
    for b in batches:
        for conv, seg, rids, roles, begin, end, offset in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows = _pieces(conv, seg, rids, roles, begin, end, offset)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _PIECE.types, strict=True)], schema=_PIECE)


def repaired(conversations: DataFrame, limit: int = SEGMENT) -> DataFrame:
    """(conv_id, seq, sub, turn, role, action, rendered) of every piece of the repaired (conv_id, turn, role, text)."""
    spark = conversations.sparkSession
    name = F.lower(F.trim("role"))
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv)), name), F.lit(UNKNOWN))
    kept = written(conversations.select("conv_id", "turn", code.alias("code"), "text", F.monotonically_increasing_id().alias("rid")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = kept.select("conv_id", "turn", "rid", "code").repartitionByRange(parts, "conv_id", "turn", "rid").sortWithinPartitions("conv_id", "turn", "rid")
    made = written(slim.select(F.col("conv_id").cast("long"), "rid", "code").mapInArrow(_segments(limit), PIECE + ", size long, matrix array<long>, rids array<long>, roles array<int>"))
    heads = made.where("op = 'head'")
    grouped = heads.groupBy("conv_id").agg(F.collect_list(F.struct("seg", "size", "matrix")).alias("segments")).where(F.size("segments") > 1)
    states = written(grouped.select("segments").mapInArrow(_chained, "seg long, begin int, end int, offset long"))
    columns = [c.split()[0] for c in PIECE.split(", ")]
    alone = made.where("op <> 'head'").join(states.select("seg"), "seg", "left_anti").select(columns)
    several = heads.select("conv_id", "seg", "rids", "roles").join(states, "seg").select("conv_id", "seg", "rids", "roles", "begin", "end", "offset").mapInArrow(_resolved, PIECE)
    pieces = alone.unionByName(several).join(kept.select("rid", "turn", "text"), "rid", "left")
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("role") + 1)
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\\|"))
    header = F.concat(F.when(F.col("first"), "").otherwise("<|im_end|>\n"), F.lit("<|im_start|>"), role, F.lit("\n"))
    opened = F.when(F.col("op").startswith("merge"), F.lit("\n\n")).otherwise(header)
    rendered = F.concat(opened, text, F.when(F.col("last"), "<|im_end|>\n").otherwise(""))
    return pieces.select("conv_id", "seq", "sub", "turn", role.alias("role"), F.col("op").alias("action"), rendered.alias("rendered"))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
