"""Conversation structure repair: the cheapest edits that make the roles of a conversation take turns.

Rows are brought together by conversation and sorted by turn; one pass over the sorted stream carries
a four-state dynamic program from Arrow batch to Arrow batch.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineside.llm.tables import bounded_batches

#: Costs of the edits, and of leaving a truncated turn in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A conversation's rows and backpointers stay in memory up to so many bytes each; beyond, they go to a file of the task.
IN_MEMORY = 8 << 20
#: Repaired turns in one batch at most.
CHUNK = 2048

#: What the kept roles so far end in: nothing, system, user, assistant. Nothing and assistant may end a conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn that is kept, by the initial of its role.
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state after a turn that is inserted or gets another role: the only role that can follow and is not system.
_FOLLOWS = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: What may be done at a row, in ASCII order: an insert may come before the row's own edit.
STEPS = ("D", "ID", "IK", "IR", "K", "R")
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
_LONGEST = (1 << 63) - 1


def fault(text: str, seen: bool) -> str | None:
    """The first fault of a turn: blank, duplicate or truncated."""
    shown = text.rstrip(_SPACE)
    if not shown:
        return "blank"
    if seen:
        return "duplicate"
    return None if shown[-1] in ".!?" else "truncated"


class Repair:
    """The dynamic program of one conversation.

    For each state it knows the cheapest way there and, of equal ones, the one whose edits are least as text. Two such
    ways end in a row's own edit and hold as many of these, so neither is the beginning of the other: their order is that of
    the ways they go on from, and four ranks stand for whole texts. More than one insert before a row never pays: it leads to
    the assistant state from nothing or system, where dropping that system turn is cheaper and allows at least the same.
    """

    def __init__(self) -> None:
        self.back = tempfile.SpooledTemporaryFile(max_size=IN_MEMORY)
        self.rows = tempfile.SpooledTemporaryFile(max_size=IN_MEMORY)
        self.clear()

    def clear(self) -> None:
        """Ready for the next conversation."""
        self.cost: list[int | None] = [0, None, None, None]
        self.rank, self.n = [0, 0, 0, 0], 0
        self.before = None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns: list | None = None  # least, latest, distinct
        for file in (self.back, self.rows):
            file.seek(0)
            file.truncate()

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        """One more row, in order."""
        wrong = fault(text, seen)
        if wrong:
            self.counts[wrong] += 1
        initial = role[:1]
        if self.n and self.before + initial not in _LEGAL:
            self.counts["illegal"] += 1
        self.before, self.n = initial, self.n + 1
        if turn is not None:
            if self.turns is None:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]
        raw = [x.encode("utf-8", "surrogatepass") for x in (role, text)]
        self.rows.write(np.array([turn is None, turn or 0, *map(len, raw)], "<i8").tobytes() + b"".join(raw))
        self._step(initial, wrong)

    def _step(self, initial: str, wrong: str | None) -> None:
        best: list[tuple | None] = [None] * 4
        stay = TRUNCATED if wrong == "truncated" else 0

        def offer(state: int, cost: int, source: int, step: int) -> None:
            way = (cost, self.rank[source], step, source)
            if best[state] is None or way < best[state]:
                best[state] = way

        for source, cost in enumerate(self.cost):
            if cost is None:
                continue
            for state, paid, shift in ((source, cost, False), (_FOLLOWS[source], cost + INSERT, True)):
                offer(state, paid + DELETE, source, 1 if shift else 0)
                if wrong in ("blank", "duplicate"):
                    continue
                if initial in _KEPT[state]:
                    offer(_KEPT[state][initial], paid + stay, source, 2 if shift else 4)
                offer(_FOLLOWS[state], paid + REROLE + stay, source, 3 if shift else 5)
        order = sorted((way[1], way[2], state) for state, way in enumerate(best) if way)
        self.cost = [way and way[0] for way in best]
        for place, (_, _, state) in enumerate(order):
            self.rank[state] = place
        self.back.write(bytes(255 if way is None else way[3] << 3 | way[2] for way in best))

    def finish(self) -> tuple[int, bytearray, bool]:
        """The least cost, the steps of all rows, and whether an assistant turn is inserted at the end."""
        ends = [(self.cost[s] + more, self.rank[s], s) for s, more in ((NOTHING, 0), (USER, INSERT), (ASSISTANT, 0)) if self.cost[s] is not None]
        cost, _, state = min(ends)
        closing = state == USER
        steps, block = bytearray(self.n), 1 << 16
        for first in range((max(self.n, 1) - 1) // block * block, -1, -block):
            self.back.seek(4 * first)
            held = self.back.read(4 * min(block, self.n - first))
            for i in range(len(held) // 4 - 1, -1, -1):
                found = held[4 * i + state]
                steps[first + i], state = found & 7, found >> 3
        return cost, steps, closing

    def replay(self, steps: bytearray, closing: bool) -> Iterator[tuple[str, int | None, str, str]]:
        """The repaired turns in order: edit, turn (None if inserted), role, text. Deleted ones are left out."""
        self.rows.seek(0)
        state = NOTHING
        for step in steps:
            missing, turn, a, b = np.frombuffer(self.rows.read(32), "<i8").tolist()
            role, text = (self.rows.read(n).decode("utf-8", "surrogatepass") for n in (a, b))
            *inserted, edit = STEPS[step]
            if inserted:
                state = _FOLLOWS[state]
                yield "I", None, _NAMES[state], ""
            if edit == "K":
                state = _KEPT[state][role[:1]]
                yield "K", None if missing else turn, role, text
            elif edit == "R":
                state = _FOLLOWS[state]
                yield "R", None if missing else turn, _NAMES[state], text
        if closing:
            yield "I", None, "assistant", ""

    def missing_turns(self) -> int:
        """Turn numbers between the first and the last that no row has."""
        return min(self.turns[1] - self.turns[0] + 1 - self.turns[2], _LONGEST) if self.turns else 0


def _in_order(rows: DataFrame, gone: Column | None) -> DataFrame:
    """Rows of a conversation in one partition, sorted by turn (nulls first), role and text; ``seen`` marks what came before.

    The count of what came before and the order both work within the partitions of one shuffle.
    """
    bounded_batches(rows.sparkSession)
    absent = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
    blank = F.lit(" ")
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(absent, "").otherwise(F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
        F.when(absent, "").otherwise(F.coalesce(F.col("text").cast("string"), blank)).alias("text"), absent.alias("gone"))
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text", "seen")]
    return (plain.repartition("conv_id").withColumn("seen", F.row_number().over(same) > 1)
            .sortWithinPartitions(*order)
            .select(F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv"),
                    F.col("turn").isNull().alias("no_turn"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "gone", "seen"))


def _streamed(rows: DataFrame, gone: Column | None, schema: str, tell: Callable[[Repair], Iterator[tuple]]) -> DataFrame:
    """One pass over the sorted rows; ``tell`` gives the rows of a conversation that is complete."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held, now, out = [c.split()[0] for c in schema.split(", ")], Repair(), None, []

        def complete() -> Iterator[pd.DataFrame]:
            for row in tell(held):
                out.append((*now, *row))
                if len(out) >= CHUNK:
                    yield pd.DataFrame(out, columns=names)
                    out.clear()
            held.clear()

        for batch in batches:
            for no_conv, conv, no_turn, turn, role, text, away, seen in zip(*(batch[c].tolist() for c in (
                    "no_conv", "conv", "no_turn", "turn", "role", "text", "gone", "seen"))):
                if now != (no_conv, conv):
                    if now is not None:
                        yield from complete()
                    now = (no_conv, conv)
                if not away:
                    held.add(None if no_turn else turn, role, text, seen)
        if now is not None:
            yield from complete()
        if out:
            yield pd.DataFrame(out, columns=names)

    made = _in_order(rows, gone).mapInPandas(run, schema)
    return made.withColumn("conv_id", F.when(~F.col("no_conv"), F.col("conv")))


def _report(held: Repair) -> Iterator[tuple]:
    cost, steps, closing = held.finish()
    digest, kept = hashlib.sha256(), 0
    for _, _, role, text in held.replay(steps, closing):
        digest.update((("\n" if kept else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        kept += 1
    audit = "".join(map(STEPS.__getitem__, steps)) + ("I" if closing else "")
    yield held.missing_turns(), *held.counts.values(), cost, audit, digest.hexdigest(), held.n, kept


def repair_report(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and the digest of what they make.

    ``rows`` has ``conv_id, turn, role, text``. Roles must come out as an optional system turn and then pairs of
    user and assistant, told by their initials (an empty role fits nowhere), or as nothing. Keep costs 0, another role 1, delete 2 (the only
    choice for a blank or repeated turn), insert an empty turn 5; a truncated turn that stays costs 5 more. Returns
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` (an initial for each edit in
    order, K, R, D or I; of equal costs the least text)``, repaired_sha256`` (``role:text`` of what
    ``repaired_turns`` gives, joined by line feeds)``, n_rows, n_repaired``.

    Rows where ``gone`` holds count for nothing, but their conversation is returned. A conversation is
    read as a stream: four costs, four bytes a row and its rows, the latter two in a file
    of the task once they are large; the audit is one character a row. Null role and text count as one
    space; a null turn comes first and leaves no gap; a null conv_id is a conversation of its own. Rows with one
    turn are taken by role and text. An empty table gives no rows; other columns are not read.
    """
    schema = ("no_conv boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, "
              "cost long, audit string, repaired_sha256 string, n_rows long, n_repaired long")
    return _streamed(rows, gone, schema, _report).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "n_rows", "n_repaired")


def repaired_turns(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """The repaired conversations themselves: ``conv_id, position`` (from 0)``, turn`` (null where inserted)``, role, text, edit``.

    See ``repair_report`` for what is done. Conversations of which nothing is left have no rows.
    """
    def turns(held: Repair) -> Iterator[tuple]:
        _, steps, closing = held.finish()
        for position, (edit, turn, role, text) in enumerate(held.replay(steps, closing)):
            yield position, turn is None, turn or 0, role, text, edit

    schema = "no_conv boolean, conv long, position long, no_turn boolean, turn long, role string, text string, edit string"
    return _streamed(rows, gone, schema, turns).select(
        "conv_id", "position", F.when(~F.col("no_turn"), F.col("turn")).alias("turn"), "role", "text", "edit")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with planted faults, by a checksum of conversation and turn; ``gone`` marks what is dropped.

    Of twenty cases 0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it and 4 makes it the user's. Nulls
    are written as one space.
    """
    blank = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    case = F.crc32(F.encode(key, "UTF-8")) % 20
    return (rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), case.alias("_case"))
            .withColumns({"text": F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
                          "role": F.when(F.col("_case") == 4, "user").otherwise(F.col("role")), "gone": F.col("_case") == 0,
                          "_again": F.explode(F.array_repeat(F.lit(0), F.when(F.col("_case") == 3, 2).otherwise(1)))})
            .select("conv_id", "turn", "role", "text", "gone"))
