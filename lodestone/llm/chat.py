"""Chat formatting: minimum-cost repair of the turns' roles, then rendering.

A legal conversation is an optional system turn, a user turn, and then assistant and user in turn. Each turn is placed
as it is, relabelled, merged into the message before it, or placed after an inserted empty message; the cheapest way for
the whole conversation is found by dynamic programming over the automaton of legal turns. A turn's effect depends on its
role alone, so it is a small matrix of costs between states, and a conversation may be cut anywhere: the rows are dealt
by ranges of (conversation, turn), every range gives its matrix for the conversations at its two edges, the driver
chooses the states at the borders (a few numbers a range), and every range then traces its own turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import tidied
from lodestone.session import shared_dir
from lodestone.ship import ship

ROLES = ("system", "user", "assistant")
#: State before the first turn; then the role of the message that is open.
START = 0
_NEXT = {START: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
_FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    insert: int = 2
    relabel: int = 3


@dataclass(frozen=True)
class Step:
    cost: int
    state: int
    action: str
    inserted: int = 0  # state of the empty message before it


def steps(role: int, state: int, costs: Costs) -> list[Step]:
    """What may be done in `state` with a turn of `role` (1 to 3; 0: none of them): one way, the cheapest, into each state."""
    out: dict[int, Step] = {}

    def offer(step: Step) -> None:
        if step.state not in out or step.cost < out[step.state].cost:
            out[step.state] = step

    change = lambda to: 0 if to == role else costs.relabel
    for to in _NEXT[state]:
        offer(Step(change(to), to, "keep" if to == role else "relabel"))
    if state != START:
        offer(Step(costs.merge + change(state), state, "merge" if state == role else "merge_relabel"))
    for between in _NEXT[state]:
        for to in _NEXT[between]:
            offer(Step(costs.insert + change(to), to, "keep" if to == role else "relabel", between))
    return sorted(out.values(), key=lambda s: s.state)


class Automaton:
    def __init__(self, costs: Costs = Costs()):
        self.table = {(r, s): steps(r, s, costs) for r in range(4) for s in range(4)}

    def forward(self, roles: list[int], entry: list[int]) -> tuple[list[int], list[list[tuple[int, Step] | None]]]:
        """The least cost of each state after the turns, and for each turn and state where it came from. Ties: the smaller state before."""
        now, back = entry, []
        for role in roles:
            after, came = [_FAR] * 4, [None] * 4
            for s in range(4):
                if now[s] < _FAR:
                    for step in self.table[role, s]:
                        if now[s] + step.cost < after[step.state]:
                            after[step.state], came[step.state] = now[s] + step.cost, (s, step)
            back.append(came)
            now = after
        return now, back

    def matrix(self, roles: list[int]) -> list[list[int]]:
        return [self.forward(roles, [0 if x == s else _FAR for x in range(4)])[0] for s in range(4)]

    def trace(self, roles: list[int], entry: int, leave: int | None) -> list[Step]:
        """The turns' steps from state `entry` to `leave`, or to the cheapest state, the smaller one in ties."""
        now, back = self.forward(roles, [0 if x == entry else _FAR for x in range(4)])
        at, out = min(range(4), key=lambda s: (now[s], s)) if leave is None else leave, []
        for came in reversed(back):
            at, step = came[at]
            out.append(step)
        return out[::-1]


def borders(parts: list[dict]) -> dict[int, tuple[int | None, int | None, bool]]:
    """For each part, in order: the state in which its first conversation enters, that in which its last one leaves
    (None: it ends there, or nothing is asked), and whether its last conversation goes on.

    parts: part, first and last conversation, one (the part holds a single conversation), head and tail matrices.
    """
    out = {p["part"]: [START, None, False] for p in parts}
    i = 0
    while i < len(parts):
        j = i
        while j + 1 < len(parts) and parts[j + 1]["first"] == parts[j]["last"] and (j == i or parts[j]["one"]):
            j += 1
        if j > i:  # one conversation from the tail of i to the head of j
            costs, back = [0 if s == START else _FAR for s in range(4)], []
            for k in range(i, j + 1):
                m = parts[k]["tail" if k == i else "head"]
                came = [min(range(4), key=lambda s, to=to: (costs[s] + m[s][to], s)) for to in range(4)]
                costs = [min(costs[came[to]] + m[came[to]][to], _FAR) for to in range(4)]
                back.append(came)
            at = min(range(4), key=lambda s: (costs[s], s))
            for k in range(j, i, -1):
                before = back[k - i][at]
                if k == j:
                    out[parts[k]["part"]][0] = before
                    if parts[k]["one"]:
                        out[parts[k]["part"]][1] = at
                else:
                    out[parts[k]["part"]][:2] = [before, at]
                at = before
                out[parts[k - 1]["part"]][1:] = [at, True]
            i = j if not parts[j]["one"] else j + 1
        else:
            i += 1
    return {k: tuple(v) for k, v in out.items()}


_SUMMARY = "part int, first long, last long, one boolean, head array<array<long>>, tail array<array<long>>"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[int], list, list[str]]]:
    """(conversation, roles, turns, texts) in the order of the rows."""
    conv, roles, turns, texts, begun = None, [], [], [], False
    for batch in batches:
        for c, t, r, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if begun and c != conv:
                yield conv, roles, turns, texts
                roles, turns, texts = [], [], []
            conv, begun = c, True
            roles.append(r), turns.append(t), texts.append(x)
    if begun:
        yield conv, roles, turns, texts


def _marks(marks: dict[str, str]) -> re.Pattern:
    own = {marks["end"].strip(), *(marks["open"].format(role).strip() for role in ROLES)} - {""}
    return re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True))) or "(?!)")


def render(step: Step, text: str, first: bool, last: bool, marks: dict[str, str], found: re.Pattern) -> str:
    """What a turn adds to the rendered conversation; all turns' pieces in order are the whole."""
    text = found.sub(lambda m: f"{m[0][0]} {m[0][1:]}", text)  # no mark can come from a text
    out = "\n" + text if step.action.startswith("merge") else ("" if first else marks["end"]) + (marks["open"].format(ROLES[step.inserted - 1]) + marks["end"] if step.inserted else "") + marks["open"].format(ROLES[step.state - 1]) + text
    return out + marks["end"] if last else out


MARKS = {"open": "<|{}|>\n", "end": "<|end|>\n"}


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs(), marks: dict[str, str] = MARKS) -> DataFrame:
    """A row per turn: id, turn, the role it has now, action, inserted (role of an empty message before it), cost, rendered.

    Concatenated in the order of turns (ties: role, then text), `rendered` is the repaired conversation. A null or unknown
    role is always relabelled, roles are compared in lower case without outer blanks, a null text is empty, rows with a
    null id make one conversation, null turns come first, and repeated rows are turns of their own. A conversation may
    end with either side. A text that holds one of the marks themselves gets a blank after the mark's first character,
    so that a reader finds no turn that isn't there; everything else in a text stays as it is. Other columns are left
    aside; an empty table gives no row. A conversation of any length is spread over as many ranges as its rows fill, and a
    very long text is one row's.
    """
    spark = ship(turns.sparkSession)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    role = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.lower(F.trim(F.col(role_col).cast("string")))), F.lit(0)).cast("int")
    rows = turns.select(F.col(id_col).cast("long").alias("_conv"), F.col(turn_col).cast("long").alias("_turn"), role.alias("_role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    # the hash lets a turn number that repeats very often be cut, too
    order = (F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_first(), F.col("_role"), F.xxhash64("_text"), F.col("_text"))
    rows = rows.repartitionByRange(*order[:4]).sortWithinPartitions(*order).checkpoint()  # parts stay what they are for both passes
    machine = Automaton(costs)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = tail = None
        n = 0
        for conv, roles, _, _ in _conversations(batches):
            if not n:
                head = conv, machine.matrix(roles)
            tail, n = (conv, roles), n + 1
        if n:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": head[0], "last": tail[0], "one": n == 1, "head": head[1], "tail": machine.matrix(tail[1])}], schema=pa.schema([("part", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("one", pa.bool_()), ("head", pa.list_(pa.list_(pa.int64()))), ("tail", pa.list_(pa.list_(pa.int64())))]))

    known = borders(sorted((r.asDict() for r in rows.select("_conv", "_turn", "_role", F.lit("").alias("_text")).mapInArrow(tidied(summarise), _SUMMARY).collect()), key=lambda r: r["part"]))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = _marks(marks)
        entry, leave, goes_on = known.get(TaskContext.get().partitionId(), (START, None, False))
        found, out, size = _conversations(batches), [], 0
        now = next(found, None)
        while now:
            following = next(found, None)
            conv, roles, numbers, texts = now
            path = machine.trace(roles, entry, leave if following is None else None)
            for k, (step, number, text) in enumerate(zip(path, numbers, texts, strict=True)):
                piece = render(step, text, entry == START and k == 0, k == len(path) - 1 and not (following is None and goes_on), marks, inside)
                out.append((conv, number, ROLES[step.state - 1], step.action, ROLES[step.inserted - 1] if step.inserted else None, step.cost, piece))
                size += len(piece) + 64
                if size > 8 << 20:
                    yield _rows(out)
                    out, size = [], 0
            now, entry = following, START
        if out:
            yield _rows(out)

    out = rows.mapInArrow(tidied(repair), "_conv long, _turn long, role string, action string, inserted string, cost long, rendered string")
    return out.select(F.col("_conv").alias(id_col), F.col("_turn").alias(turn_col), "role", "action", "inserted", "cost", "rendered")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_conv", "_turn", "role", "action", "inserted", "cost", "rendered"])
