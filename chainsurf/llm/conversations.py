"""Conversation structure repair by iterative-deepening A*.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``.  Its rows, in
order of turn (nulls first, then role and text), are edited one by one: Delete (2),
Insert an empty user or assistant row (5), Keep (0), Rerole to user or assistant (1); a
blank or duplicate row has to be deleted, a truncated one that stays costs 5 more.  The
search walks these edits depth-first in the order of their initials D, I, K, R under a
cost bound that grows to the least cost beyond it; a table of (row, state) keeps the
budget that failed there.  The first accepting path under the first bound that has one is
cheapest and, of the cheapest, least in ASCII.

What is left to pay is bounded from below by the rows that cost something whatever is
done.  A conversation of more than ``BLOCK`` rows is searched block by block from its end:
the cheapest ends of a block, found by such a search from each state, are the exact bounds
of the block before, so work grows with the rows and not with their square.

Rows of all conversations share one exchange, by conversation.  Each row is sent to its
task in two forms, sorted so that all the small ones (role and fault, one byte) of a
conversation come before the texts: when the first text arrives the edits are known, and
texts stream into the digest.  So a task holds one byte and one edit for each row of one
conversation, besides one Arrow batch.  The digest of a conversation is a chain over its
texts, so its rows do pass through one task, however many they are.

Nulls count as one space: in ids and turns for the damage, in roles and texts for all.
Null ids make one conversation.  Roles count by their first character; an empty role has
none and can't be kept.  Equal rows are duplicates of each other; equal turns are ordered
by role and text.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
_START, _SYSTEM, _USER, _PAIR = range(4)  # states: nothing yet, after s, after u, after ua
_AFTER = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _PAIR, (_PAIR, "u"): _USER}
_WANTED = {_START: ("u", _USER), _SYSTEM: ("u", _USER), _USER: ("a", _PAIR), _PAIR: ("u", _USER)}  # what a new role has to be
_GOOD, _GONE, _CUT = range(3)  # faults: none, blank or duplicate, truncated
_FAULTS = ["", "blank", "duplicate", "truncated"]
_NEVER = 1 << 60


def _search(rows: list[tuple[str, int]], state: int, ends: list[int], close: bool) -> tuple[int, str]:
    """(least cost, its first path in ASCII order) of editing ``rows`` from a state on.

    ``ends`` has the cost that is still to come in each state after the rows; ``close``
    allows inserts after the last row.
    """
    n, best_end = len(rows), min(ends)
    least = [best_end] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (0 if rows[i][1] == _GOOD else 2)
    bound = least[0]
    while True:
        failed: dict[tuple[int, int], int] = {}
        beyond = _NEVER
        # a node: row, state, cost, the edit that led there, and the number of its next edit
        stack = [[0, state, 0, "", 0]]
        while stack:
            node = stack[-1]
            i, q, cost, _, edit = node
            if edit == 0:
                if i == n and cost + ends[q] <= bound:
                    return cost + ends[q], "".join(x[3] for x in stack)
                left = bound - cost
                if failed.get((i, q), -1) >= left:
                    stack.pop()
                    continue
                failed[i, q] = left  # it holds once all edits have failed; until then the path passes here only with less left
            if edit == 4:
                stack.pop()
                continue
            node[4] = edit + 1
            if i == n:
                if edit != 1 or not close:
                    continue
                to = (n, _WANTED[q][1], cost + 5, "I")
            else:
                role, fault = rows[i]
                if edit == 0:
                    to = (i + 1, q, cost + 2, "D")
                elif edit == 1:
                    to = (i, _WANTED[q][1], cost + 5, "I")
                elif fault == _GONE:
                    continue
                elif edit == 2:
                    after = _AFTER.get((q, role))
                    if after is None:
                        continue
                    to = (i + 1, after, cost + (5 if fault == _CUT else 0), "K")
                else:
                    to = (i + 1, _WANTED[q][1], cost + (6 if fault == _CUT else 1), "R")
            reach = to[2] + (least[to[0]] if to[0] < n else min(ends[to[1]], best_end + 5 if close else _NEVER))
            if reach <= bound:
                stack.append([*to, 0])
            elif reach < beyond:
                beyond = reach
        if beyond >= _NEVER:
            return _NEVER, ""
        bound = beyond


_ACCEPT = [0, _NEVER, _NEVER, 0]


def _repair(rows: list[tuple[str, int]]) -> tuple[int, str]:
    blocks = [rows[i:i + BLOCK] for i in range(0, len(rows), BLOCK)] or [[]]
    ends = [_ACCEPT]  # of each block, from the last one on
    for i in range(len(blocks) - 1, 0, -1):
        ends.append([_search(blocks[i], q, ends[-1], close=i == len(blocks) - 1)[0] for q in range(4)])
    ends.reverse()
    state, paths, total = _START, [], 0
    for i, block in enumerate(blocks):
        cost, path = _search(block, state, ends[i], close=i == len(blocks) - 1)
        total = cost if i == 0 else total
        paths.append(path)
        state = walk(block, path, state)
    return total, "".join(paths)


def walk(rows: list[tuple[str, int]], path: str, state: int = _START) -> int:
    """The state after the edits of a path."""
    i = 0
    for edit in path:
        if edit == "K":
            state = _AFTER[state, rows[i][0]]
        elif edit != "D":
            state = _WANTED[state][1]
        i += edit != "I"
    return state


@lru_cache(maxsize=1 << 14)
def _repair_short(codes: bytes) -> tuple[int, str]:
    return _repair([("saux"[c >> 2], c & 3) for c in codes])


def repair(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation given as one byte a row: 4 * (0 s, 1 a, 2 u, 3 other) + (0 good, 1 to be deleted, 2 truncated)."""
    return _repair_short(codes) if len(codes) <= BLOCK else _repair([("saux"[c >> 2], c & 3) for c in codes])


_SPACE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows as the test of ``op11`` damages them; none is dropped here, but may have no copies."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    out = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("_kind"))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"))


def _fault(text: Column, again: Column) -> Column:
    """The number of a row's first fault."""
    bare = F.rtrim(text, F.lit(_SPACE))
    return F.when(bare == "", 1).when(again, 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)


_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SOUND = ("su", "ua", "au")


class _Conversation:
    """What is known of the conversation that streams through a task."""

    def __init__(self, conv_id):
        self.id, self.codes, self.counts = conv_id, bytearray(), [0] * 4
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.initial: str | None = None
        self.edits: str | None = None

    def see(self, turn, initial: str, fault: int) -> None:
        if turn is not None:
            if self.last is None or turn != self.last:
                self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.initial is not None and self.initial + initial not in _SOUND:
            self.illegal += 1
        self.initial = initial
        self.counts[fault] += 1
        self.codes.append(4 * {"s": 0, "a": 1, "u": 2}.get(initial, 3) + (0 if fault == 0 else 2 if fault == 3 else 1))

    def solve(self) -> None:
        self.cost, self.edits = repair(bytes(self.codes))
        self.at, self.row, self.state, self.digest, self.any = 0, 0, _START, hashlib.sha256(), False

    def _write(self, line: str) -> None:
        self.digest.update(("\n" + line if self.any else line).encode())
        self.any = True

    def _inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self._write("user:" if _WANTED[self.state][0] == "u" else "assistant:")
            self.state, self.at = _WANTED[self.state][1], self.at + 1

    def take(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.edits[self.at]
        if edit == "K":
            self._write(f"{role}:{text}")
            self.state = _AFTER[self.state, role[:1]]
        elif edit == "R":
            self._write(("user:" if _WANTED[self.state][0] == "u" else "assistant:") + text)
            self.state = _WANTED[self.state][1]
        self.at += 1

    def done(self) -> tuple:
        if self.edits is None:
            self.solve()
        self._inserts()
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        return (self.id, gaps, *self.counts[1:], self.illegal, self.cost, self.edits, self.digest.hexdigest())


def audit(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``damaged`` rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    text, there = F.col("text"), F.col("copies") > 0
    rows = rows.select("conv_id", "turn", "copies", F.when(there, F.col("role")).alias("role"), F.when(there, text).alias("text"))
    before = Window.partitionBy("conv_id", "copies", "role", "_name").orderBy("turn")  # within the exchange by conversation
    # a repeated row stands for both its copies; rows with one and with two meet by their names
    named = rows.repartition("conv_id").withColumn("_name", F.md5("text")).withColumn("copies", F.explode(F.when(F.col("copies") == 2, F.array(F.lit(1), F.lit(1))).otherwise(F.array("copies"))))
    seen = named.withColumn("_fault", F.when(F.col("copies") > 0, _fault(F.col("text"), F.row_number().over(before) > 1))).drop("_name")
    # equal turns are ordered by role and text in both forms; only what a form needs leaves Spark
    both = seen.withColumn("_phase", F.explode(F.when(F.col("copies") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    dealt = both.sortWithinPartitions("conv_id", "_phase", F.col("turn").asc_nulls_first(), "role", "text")
    texts = F.col("_phase") == 1
    dealt = dealt.select("conv_id", "turn", "_phase", "_fault", F.when(texts, F.col("role")).otherwise(F.substring("role", 1, 1)).alias("role"), F.when(texts, F.col("text")).alias("text"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: _Conversation | None = None
        out: list[tuple] = []
        key = pa.int64()
        for batch in batches:
            key = batch.schema.field("conv_id").type
            for conv_id, turn, phase, fault, role, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at is None or at.id != conv_id:
                    if at is not None:
                        out.append(at.done())
                    at = _Conversation(conv_id)
                if phase == 0:
                    if role is not None:
                        at.see(turn, role, fault)
                else:
                    if at.edits is None:
                        at.solve()
                    at.take(role, body)
            if out:
                yield table(out, key)
                out = []
        if at is not None:
            yield table([*out, at.done()], key)

    def table(found: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        names, kinds = ["conv_id", *(x.split()[0] for x in _OUT.split(", "))], [key] + [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(stream, f"conv_id {kind}, {_OUT}")


def repaired(rows: DataFrame) -> DataFrame:
    """The audit of every conversation of a table after the damage of the test."""
    return audit(damaged(rows))
