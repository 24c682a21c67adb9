"""Repair of conversations' turns at least cost, by cost layers over a grammar's states (operator 11).

The grammar of role initials is ``(s?(ua)+)?``. Before every turn, and for every cost, a bitset holds the states from which the
rest of the conversation can be accepted at that cost; all layers of a turn are one integer, four bits a layer. A turn's
integer comes from the next one's by shifts: deleting shifts by the layers it costs, keeping and changing a role also
take each bit to the states that lead there, inserting does so without a turn. The first layer that has the start state gives the
cost. Walking forward, a bit that is set where an edit leads, at the right distance in cost, shows an edit that is part of a
cheapest repair; the ASCII-least one is taken, and it fixes the next state, so the audit is the least one.

Layers count from the lowest that is not empty, and there are never more than sixteen, so a turn needs the same memory however
long its conversation. Both walks are streams over sorted partitions: a conversation is read in order by one
task (its text is hashed in order), but never held; of a turn, only the moves from each state are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewave.llm.common import SPACES

#: Costs of the edits; a turn that stays and ends in the middle of a sentence adds ``TRUNCATED``.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: 0 start, 1 after the system turn, 2 after a user's, 3 after an assistant's; 0 and 3 accept.
NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_EACH = int("1" * 16, 16)  # one bit a layer
_ROLES = {"u": "user", "a": "assistant"}


def _before(layers: int, initial: str) -> int:
    """The states that a turn of this initial leads from into the states of each layer."""
    out = 0
    for (own, state), to in NEXT.items():
        if own == initial:
            out |= ((layers >> to) & _EACH) << state
    return out


def _inserted(layers: int) -> int:
    """The layers with those that up to two inserted turns reach; more never pay."""
    for _ in range(2):
        layers |= (_before(layers, "u") | _before(layers, "a")) << 4 * INSERT
    return layers


def _settled(layers: int) -> tuple[int, int]:
    """The layers with every state at its least cost only, from the lowest one on; and that one's cost."""
    seen, out, cost, first = 0, 0, 0, None
    while seen != 15:
        fresh = (layers >> 4 * cost) & 15 & ~seen
        if fresh:
            first = cost if first is None else first
            out |= fresh << 4 * (cost - first)
            seen |= fresh
        cost += 1
    return out, first


def _costs(layers: int) -> list[int]:
    return [next(c for c in range(16) if layers >> (4 * c + s) & 1) for s in range(4)]


END = _settled(_inserted(0b1001))[0]


@lru_cache(maxsize=1 << 16)
def turn_back(after: int, initial: str, forced: bool, truncated: bool) -> tuple[int, int, str]:
    """The layers before a turn, what all of them cost more than those after it, and the moves from each state.

    A move is the edits' initials up to the one that takes the turn, and the state that follows.
    """
    more = TRUNCATED * truncated
    layers = after << 4 * DELETE
    if not forced:
        layers |= _before(after, initial) << 4 * more
        layers |= (_before(after, "u") | _before(after, "a")) << 4 * (RENAME + more)
    own, base = _settled(_inserted(layers))
    here, there, moves = [c + base for c in _costs(own)], _costs(after), []
    for state in range(4):
        edits = ""
        while True:
            need = "a" if state == 2 else "u"
            to, kept = NEXT[need, state], NEXT.get((initial, state))
            if DELETE + there[state] == here[state]:
                moves.append(f"{edits}D{state}")
            elif INSERT + here[to] == here[state]:
                edits, state = edits + "I", to
                continue
            elif not forced and kept is not None and more + there[kept] == here[state]:
                moves.append(f"{edits}K{kept}")
            else:
                moves.append(f"{edits}R{to}")
            break
    return own, base, " ".join(moves)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns from each conversation's last to its first, with their moves and the cost from there on."""
    before, layers, cost = (), END, 0
    for batch in batches:
        moves, costs = [], []
        for conv, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "fault"))):
            if before != (conv,):
                before, layers, cost = (conv,), END, 0
            layers, more, own = turn_back(layers, initial, fault in ("blank", "duplicate"), fault == "truncated")
            cost += more
            moves.append(own)
            costs.append(cost + _costs(layers)[0])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(moves, pa.string()), pa.array(costs, pa.int64())], names=[*batch.schema.names, "moves", "cost"])


@lru_cache(maxsize=1 << 16)
def _parsed(moves: str) -> list[tuple[str, int]]:
    return [(m[:-1], int(m[-1])) for m in moves.split(" ")]


class _Repair:
    """One conversation while its turns pass: the state, the counts, the audit and the hash of what is repaired."""

    def __init__(self, cost: int):
        self.cost, self.state, self.audit, self.hash, self.rows = cost, 0, [], hashlib.sha256(), 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initial = 0, None
        self.low = self.high = self.last = None
        self.turns = 0

    def _out(self, role: str, text: str, edit: str) -> tuple[int, str, str, str]:
        self.hash.update(("\n" * (self.rows > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.rows += 1
        return self.rows - 1, role, text, edit

    def take(self, turn: int | None, role: str, text: str, initial: str, fault: str | None, moves: str) -> list[tuple[int, str, str, str]]:
        """The repaired turns that this one makes: (place, role, text, edit)."""
        if fault:
            self.faults[fault] += 1
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.last
            self.last = turn
        edits, state = _parsed(moves)[self.state]
        self.audit.append(edits)
        out = []
        for edit in edits:
            need = "a" if self.state == 2 else "u"
            if edit == "I":
                out.append(self._out(_ROLES[need], "", edit))
                self.state = NEXT[need, self.state]
            elif edit != "D":
                out.append(self._out(role if edit == "K" else _ROLES[need], text, edit))
        self.state = state
        return out

    def end(self) -> list[tuple[int, str, str, str]]:
        """The turns to insert at the end."""
        out = []
        while self.state in (1, 2):
            need = "a" if self.state == 2 else "u"
            out.append(self._out(_ROLES[need], "", "I"))
            self.audit.append("I")
            self.state = NEXT[need, self.state]
        return out

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.faults.values(), int(self.illegal), self.cost, "".join(self.audit), self.hash.hexdigest())


_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id long, place long, role string, text string, edit string"
_EMPTY_HASH = hashlib.sha256().hexdigest()


def _forward(summary: bool):
    kinds = [pa.int64()] * 7 + [pa.string()] * 2 if summary else [pa.int64()] * 2 + [pa.string()] * 3
    names = [c.split(" ")[0] for c in (_SUMMARY if summary else _TURNS).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, own, rows = (), None, []

        def finished() -> None:
            if own is not None:
                last = own.end()
                rows.extend([(before[0], *own.summary())] if summary else [(before[0], *r) for r in last])

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for conv, turn, role, text, initial, fault, moves, cost in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "initial", "fault", "moves", "cost"))):
                if before != (conv,):
                    finished()
                    before, own = (conv,), _Repair(cost)
                out = own.take(turn, role, text, initial, fault, moves)
                if not summary:
                    rows.extend((conv, *r) for r in out)
            if rows:
                yield batch_of()
                rows = []
        finished()
        if rows:
            yield batch_of()

    return run


def _with_moves(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The turns in order with their faults and moves; partitioned by conversation once, sorted anew within the partitions."""
    rows = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text")))).repartition("conv_id")
    own = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    tail = F.rtrim(F.col("text"), F.lit(SPACES.decode()))
    fault = F.when(tail == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), "truncated")
    coded = rows.withColumn("nth", F.row_number().over(own)).withColumns({"initial": F.substring("role", 1, 1), "fault": fault, "again": F.col("nth") > 1}).drop("nth")
    late_first = [F.col("conv_id"), F.desc_nulls_last("turn"), *(F.desc(c) for c in ("role", "text", "again"))]
    schema = ", ".join(f"{n} {t}" for n, t in coded.dtypes) + ", moves string, cost long"
    moves = coded.sortWithinPartitions(*late_first).mapInArrow(_backward, schema)
    return moves.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again")


def repairs(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    A conversation's rows go by turn, nulls first, then by role and text. A null role or text is one space; a null conv_id is a
    conversation of its own. Each row counts for its first fault: blank, duplicate (role and text seen earlier), truncated. Edits
    are Keep 0, Rerole 3, Delete 4 (the only one of blank and duplicate rows), Insert 3; a truncated row that stays adds 3. Roles
    that begin with none of s, u, a cannot be kept. ``audit`` is the least string of edits' initials among the cheapest repairs.
    Rows that are equal in all are repeats: the second is a duplicate. Further columns are left out; no rows give none. Texts of any
    length pass once, whole.
    """
    return _with_moves(df, conv_id, turn, role, text).mapInArrow(_forward(True), _SUMMARY)


def repaired_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, role, text, edit): the turns of every conversation after the repair of :func:`repairs`, from place 0 on."""
    return _with_moves(df, conv_id, turn, role, text).mapInArrow(_forward(False), _TURNS)


def damaged(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32('conv_id:turn') modulo 20, a null standing for one space.

    0 drops the row, 1 empties its text, 2 removes the text's ``.!?``, 3 repeats the row, 4 makes the role ``user``; others stay.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("one")).drop("one")


def repairs_of_damaged(df: DataFrame) -> DataFrame:
    """:func:`repairs` of :func:`damaged`, with a row for every conversation of ``df``, also those that lost all rows."""
    found = repairs(damaged(df)).withColumnRenamed("conv_id", "own")
    every = df.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    both = every.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    return both.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill({"audit": "", "repaired_sha256": _EMPTY_HASH})
