"""Damaged conversations: their faults, and the cheapest edits that make their roles alternate again.

The edits are found by depth-first branch and bound. A node says how many rows
have been dealt with and what may follow: nothing yet, a system message, a
user's or an assistant's. A prefix of edits is dropped when its node was
reached by a cheaper one (or an equally cheap one whose initials come first),
or when its cost and a lower bound of the rows still to come exceed the best
whole solution so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are searched together; a longer conversation is searched part by part, with the best prefix of each node handed on.
PART = 200
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
# What may have been put out so far: nothing, a system message, one that an assistant must follow, one of an assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
_TURN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_NAME = {USER: "user", ASSISTANT: "assistant"}
BLANK_OF = r"[^\x20\x09-\x0D]"

Found = dict[int, tuple[int, str]]


def bounds(rows: list[tuple[str, bool, bool]]) -> list[int]:
    """Of each place, the least that the rows from there on cost whatever came before: rows that must go, truncated rows, rows whose role fits nowhere."""
    out = [0]
    for initial, must_go, truncated in reversed(rows):
        least = COST[DELETE] if must_go else min(COST[DELETE], truncated + (0 if initial in ("s", "u", "a") else COST[REROLE]))
        out.append(out[-1] + least)
    return out[::-1]


def cheapest(rows: list[tuple[str, bool, bool]], entry: Found, ends: tuple[int, ...] | None) -> Found:
    """The best ``(cost, initials)`` with which all rows are dealt with, by the state reached; the least cost first, then the initials that come first.

    :param rows: role's initial, whether the row must go, whether its text is truncated.
    :param entry: by state, cost and initials of what came before; ``ends``: states in which the conversation may stop
        (only the best one is searched for then), None: rows follow, and each state's best is wanted.
    """
    n, rest = len(rows), bounds(rows)
    table: list[Found] = [{} for _ in range(n + 1)]  # dominance: by node, the best prefix so far
    done: Found = {}
    best: tuple[int, str] | None = None  # incumbent
    stack = [(0, state, cost, initials) for state, (cost, initials) in sorted(entry.items(), key=lambda x: x[1], reverse=True)]
    while stack:
        i, state, cost, initials = stack.pop()
        known = table[i].get(state)
        if known is not None and known <= (cost, initials):
            continue
        if ends is not None:
            limit = best[0] if best is not None else None
        else:  # two insertions lead from the end of any way to either of the last two states
            limit = min(x[0] for x in done.values()) + 2 * COST[INSERT] if done and state in (USER, ASSISTANT) else None
        if limit is not None and cost + rest[i] > limit:
            continue
        table[i][state] = (cost, initials)
        if i == n:
            if ends is None:
                done[state] = (cost, initials)
                continue
            if state in ends and (best is None or (cost, initials) < best):
                best = (cost, initials)
                done = {state: best}
        follow = []
        if ends is None or i < n or state not in ends:
            follow.append((i, _TURN[state], cost + COST[INSERT], initials + INSERT))
        if i < n:
            initial, must_go, truncated = rows[i]
            follow.append((i + 1, state, cost + COST[DELETE], initials + DELETE))
            if not must_go:
                follow.append((i + 1, _TURN[state], cost + COST[REROLE] + truncated, initials + REROLE))
                if (state, initial) in _KEPT:
                    follow.append((i + 1, _KEPT[state, initial], cost + truncated, initials + KEEP))
        # The child of least cost, then of first initials, is looked at first.
        stack.extend(sorted(follow, key=lambda x: (x[2] + rest[x[0]], x[3]), reverse=True))
    return done


class Repairer:
    """One conversation at a time, row by row; holds a part of its rows, and of each state the best prefix and the digest of what it leaves."""

    def __init__(self):
        self.rows: list[tuple[str, str, bool, bool]] = []
        self.states = {NOTHING: (0, "", hashlib.sha256(), False)}
        self.last = None
        self.sums = np.zeros(4, np.int64)  # blank, duplicate, truncated, illegal

    def add(self, role: str, text: str, fault: int) -> None:
        self.sums[:3] += [fault == 1, fault == 2, fault == 3]
        initial = role[:1]
        if self.last is not None:
            self.sums[3] += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.rows.append((role, text, fault in (1, 2), fault == 3))
        if len(self.rows) >= PART:
            self._search(None)

    def _search(self, ends: tuple[int, ...] | None) -> None:
        """Replaces the states by those after the rows at hand; digests go on from the prefix that each came from."""
        rows = [(role[:1], must_go, truncated) for role, _, must_go, truncated in self.rows]
        found = {}
        # Each way in is searched alone, with its own cost, so that what it adds can be told from what it came with.
        for state, (cost, initials, _, _) in self.states.items():
            for reached, (more, edits) in cheapest(rows, {state: (0, "")}, ends).items():
                mine = (cost + more, initials + edits)
                if reached not in found or mine < found[reached][:2]:
                    found[reached] = (*mine, state, edits)
        if ends is not None:
            least = min(found, key=lambda s: found[s][:2])
            found = {least: found[least]}
        out = {}
        for reached, (cost, initials, state, edits) in found.items():
            digest, started = self.states[state][2].copy(), self.states[state][3]
            for line in self._repaired(state, edits):
                digest.update((("\n" if started else "") + line).encode())
                started = True
            out[reached] = (cost, initials, digest, started)
        self.states, self.rows = out, []

    def _repaired(self, state: int, edits: str) -> Iterator[str]:
        i = 0
        for edit in edits:
            if edit == INSERT:
                state = _TURN[state]
                yield f"{_NAME[state]}:"
                continue
            role, text, _, _ = self.rows[i]
            i += 1
            if edit == REROLE:
                state = _TURN[state]
                yield f"{_NAME[state]}:{text}"
            elif edit == KEEP:
                state = _KEPT[state, role[:1]]
                yield f"{role}:{text}"

    def finish(self) -> tuple[int, str, str]:
        """Cost, initials of the edits, digest of the repaired conversation."""
        self._search(ENDS)
        ((cost, initials, digest, _),) = self.states.values()
        return cost, initials, digest.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage chosen by ``crc32("conv_id:turn") % 20``: 0 the row goes, 1 its text does, 2 its full stops, question and exclamation marks do, 3 it is there twice, 4 its role is user. Nulls are one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key), F.lit(20))
    out = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).where("kind <> 0")
    text: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows of each content and turn once, with how many are there (``copies``), the fault of the first and that of the others: 0 none, 1 blank, 2 duplicate, 3 truncated.

    Whether a message was seen before is told by the first turn that has it, a
    partial aggregate over ids and digests, so neither a long conversation nor a
    message repeated without end is gathered.
    """
    same = F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256)
    turn = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn"))  # nulls first
    rows = rows.withColumn("same", same)
    first = rows.groupBy(F.col("conv_id").alias("f_conv"), F.col("same").alias("f_same")).agg(F.min(turn).alias("first"))
    rows = rows.groupBy("conv_id", "turn", "role", "text", "same").agg(F.sum("copies").alias("copies"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("same") == F.col("f_same")))
    blank = ~F.col("text").rlike(BLANK_OF)
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    again = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    others = F.when(blank, 1).otherwise(2)
    return rows.select("conv_id", "turn", "role", "text", "copies", F.when(blank, 1).when(again, 2).when(truncated, 3).otherwise(0).alias("fault"), others.alias("others"))


def repair(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """Faults of each conversation and the cheapest edits that give its roles' initials the form ``(s?(ua)+)?``.

    :param rows: ``conv_id``, ``turn``, ``role``, ``text``; other columns are ignored, but for that named by ``copies``: how often a row is there.
    :return: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, a row for each conversation.

    Rows are taken by turn, nulls first; rows of one turn by role and text, as
    nothing else tells them apart. Null roles and texts are one space. Keeping
    a row costs 0, another role (user or assistant) 2, deleting it 3 (blank and
    duplicate rows must go), an inserted empty message 2, a truncated row that
    stays 1; a role of no characters fits nowhere. Of equally cheap edits those whose initials come first in ASCII
    are taken. A null ``conv_id`` is a conversation; an empty table gives an
    empty one.

    A conversation's digest can only be made in order, so a conversation is
    read through by one task, sorted by Spark, a part of ``PART`` rows at a
    time; what is held of it is that part, the edits so far and four digests.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.col(copies) if copies else F.lit(1)).alias("copies"))
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy(F.col("conv_id").alias("t_conv")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    ordered = with_faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, done, id_kind = None, None, [], None

        def packed() -> pa.RecordBatch:
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_kind), *[pa.array(c, pa.int64()) for c in cols[1:6]], pa.array(cols[6], pa.string()), pa.array(cols[7], pa.string())], names=names)

        for batch in batches:
            id_kind = batch.column(0).type
            for conv, role, text, copies, fault, others in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != at:
                    if now is not None:
                        cost, audit, digest = now.finish()
                        done.append((at, *now.sums.tolist(), cost, audit, digest))
                    now, at = Repairer(), conv
                now.add(role, text, fault)
                for _ in range(copies - 1):
                    now.add(role, text, others)
            if len(done) >= 1000:
                yield packed()
                done.clear()
        if now is not None:
            cost, audit, digest = now.finish()
            done.append((at, *now.sums.tolist(), cost, audit, digest))
        if done:
            yield packed()

    fixed = ordered.select("conv_id", "role", "text", "copies", "fault", "others").mapInArrow(run, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return fixed.join(turns, F.col("conv_id").eqNullSafe(F.col("t_conv"))).select("conv_id", "gaps", *names[1:])


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged conversations, with a row for each one that was there before: zeros, no edits and the empty text's digest where no row is left."""
    there = conversations.select(F.col("conv_id").alias("o_conv")).distinct()
    out = there.join(repair(damage(conversations), "copies"), F.col("o_conv").eqNullSafe(F.col("conv_id")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(F.col("o_conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
