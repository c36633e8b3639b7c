"""Conversation structure repair: the cheapest edits that make the roles of a conversation read `(s?(ua)+)?`.

Rows go to tasks by conversation and are streamed in order of turn (nulls first; ties by role, then text). Of each row the
first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation), truncated
(the last character that is no white space is none of . ! ?). A row is kept (0), given the role user or assistant (2) or
deleted (3; blank and duplicate rows must be); a truncated row that stays adds 1; an empty user or assistant turn may be
inserted anywhere (2). Among the cheapest repairs that counts whose edits, written as K, R, D and I, come first in ASCII.

For each state of the role pattern, the state of the search holds the cost of the best edits so far and how these are
ordered among the states; it is carried from one Arrow batch to the next. Relative to the cheapest there are few such
layers, so a step is a table look-up that also gives four bytes of backpointers. These and the texts that may stay are
kept in memory up to SPOOL bytes and spilled to the task's own temporary file beyond, so that a conversation of any size
takes bounded memory, but for its audit of a byte a row and the backpointer chosen for each row. Which rows repeat an
earlier one is found by a window over (conversation, role, text), on the partitions of the same shuffle.

Null roles and texts count as empty, a null conv_id is a conversation of its own, null turns come first and do not count
for gaps. Repeated rows are duplicates. Texts of any length count whole. A conversation without rows has no result, unless
rows whose `absent` is true announce it. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

WHITE = " \t\n\v\f\r"
#: States: 0 before any turn, 1 after s, 2 after u, 3 after a. What may follow each, by initial; the role that an inserted
#: or renamed turn must have; where a conversation may end.
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = ("user", "user", "assistant", "user")
ENDS = (0, 3)
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: More insertions in a row than that come back to a state they have been in.
INSERTS = 2
LEGAL = {"su", "ua", "au"}
SPOOL = 8 << 20
_START = ((0, 0),)
_READ = 1 << 16


def _after(state: int) -> int:
    return FOLLOW[state][WANTED[state][0]]


@lru_cache(maxsize=1 << 16)
def step(layer: tuple[tuple[int, int], ...], initial: str, goes: bool, truncated: bool) -> tuple[tuple[tuple[int, int], ...], int, bytes]:
    """The layer after one row, what the least cost rose by, and for each state a byte: the state before, insertions, edit.

    A layer lists (state, cost over the least) in ASCII order of the states' best edits. All of these end with an edit of
    the same row, so none begins another and their order stays what it is, whatever follows.
    """
    found: dict[int, tuple] = {}
    for place, (state, cost) in enumerate(layer):
        at, spent = state, cost
        for inserts in range(INSERTS + 1):
            options = [("D", at, DELETE)]
            if not goes:
                if initial in FOLLOW[at]:
                    options.append(("K", FOLLOW[at][initial], TRUNCATED * truncated))
                options.append(("R", _after(at), RENAME + TRUNCATED * truncated))
            for edit, to, price in options:
                option = (spent + price, place, "I" * inserts + edit, state)
                if to not in found or option < found[to]:
                    found[to] = option
            at, spent = _after(at), spent + INSERT
    least = min(o[0] for o in found.values())
    order = sorted(found, key=lambda to: found[to][1:3])
    marks = bytes(found[to][3] | (len(found[to][2]) - 1) << 2 | "DKR".index(found[to][2][-1]) << 4 if to in found else 0 for to in range(4))
    return tuple((to, found[to][0] - least) for to in order), least, marks


def ending(layer: tuple[tuple[int, int], ...]) -> tuple[int, int, int]:
    """(cost, state, insertions) of the cheapest way to end, the first in ASCII order."""
    options = []
    for place, (state, cost) in enumerate(layer):
        at = state
        for inserts in range(INSERTS + 1):
            if at in ENDS:
                options.append((cost + INSERT * inserts, place, inserts, state))
            at = _after(at)
    cost, _, inserts, state = min(options)
    return cost, state, inserts


class Conversation:
    """One conversation, row by row."""

    def __init__(self, key: str, spool: int = SPOOL):
        self.key, self.layer, self.cost, self.rows = key, _START, 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None
        self.spool, self.marks, self.texts = spool, tempfile.SpooledTemporaryFile(spool), tempfile.SpooledTemporaryFile(spool)

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        bare = text.rstrip(WHITE)
        blank = not bare
        again = again and not blank
        truncated = not blank and not again and bare[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + truncated
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        self.layer, rise, marks = step(self.layer, initial if initial in "sua" else "", blank or again, truncated)
        self.cost += rise
        self.rows += 1
        self.marks.write(marks)
        if not (blank or again):
            for part in (role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")):
                self.texts.write(struct.pack("<q", len(part)))
                self.texts.write(part)
        else:
            self.texts.write(struct.pack("<q", -1))

    def edits(self) -> tuple[int, bytearray, int]:
        """(cost, the chosen backpointer of each row, insertions at the end)."""
        more, state, inserts = ending(self.layer)
        chosen = bytearray(self.rows)
        for end in range(self.rows, 0, -_READ):
            begin = max(0, end - _READ)
            self.marks.seek(4 * begin)
            held = self.marks.read(4 * (end - begin))
            for row in range(end - 1, begin - 1, -1):
                mark = held[4 * (row - begin) + state]
                chosen[row], state = mark, mark & 3
        return self.cost + more, chosen, inserts

    def repaired(self, chosen: bytearray, inserts: int) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the repaired turns in order, and of each deleted row ("D", "", "")."""
        self.texts.seek(0)
        state = 0

        def filled(n: int) -> Iterator[tuple[str, str, str]]:
            nonlocal state
            for _ in range(n):
                yield "I", WANTED[state], ""
                state = _after(state)

        def read() -> str | None:
            size = struct.unpack("<q", self.texts.read(8))[0]
            return None if size < 0 else self.texts.read(size).decode("utf-8", "surrogatepass")

        for mark in chosen:
            yield from filled(mark >> 2 & 3)
            edit, role = "DKR"[mark >> 4], read()
            text = None if role is None else read()
            if edit == "D":
                yield "D", "", ""
                continue
            role = WANTED[state] if edit == "R" else role
            state = FOLLOW[state][role[0]]
            yield edit, role, text
        yield from filled(inserts)

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns

    def close(self) -> None:
        self.marks.close()
        self.texts.close()


def _conversations(frames: Iterator[pd.DataFrame], spool: int) -> Iterator[Conversation]:
    """The conversations of sorted rows, each complete; it is to be used before the next is asked for."""
    now = None
    for frame in frames:
        for key, turn, role, text, again, absent in zip(frame.key, frame.turn, frame.role, frame.text, frame.again, frame.absent, strict=True):
            if now is None or now.key != key:
                if now is not None:
                    yield now
                    now.close()
                now = Conversation(key, spool)
            if not absent:
                now.add(int(turn) if turn else None, role, text, again)
    if now is not None:
        yield now
        now.close()


def _streamed(turns: DataFrame) -> DataFrame:
    """turns dealt by conversation and sorted, with `again`: role and text were seen earlier. Ids and turns go to pandas as
    strings, empty if null."""
    absent = F.coalesce(F.col("absent"), F.lit(False)) if "absent" in turns.columns else F.lit(False)
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), absent.alias("absent"))
    earlier = F.row_number().over(Window.partitionBy("key", "role", "text", "absent").orderBy("turn")) > 1
    dealt = rows.repartition("key").withColumn("again", earlier).sortWithinPartitions("key", "turn", "role", "text", "again")
    return dealt.withColumn("turn", F.coalesce(F.col("turn").cast("string"), F.lit("")))


_AUDIT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def audits(turns: DataFrame, spool: int = SPOOL) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each conversation.

    gaps: turn numbers missing between the first and the last; illegal: neighbours whose roles' initials are not su, ua or
    au; repaired_sha256: of the repaired turns as role:text, joined by newlines, as `repairs` lists them.
    """
    names = [part.split()[0] for part in _AUDIT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = []
        for held in _conversations(frames, spool):
            cost, chosen, inserts = held.edits()
            digest, audit, any_turn = hashlib.sha256(), [], False
            for edit, role, text in held.repaired(chosen, inserts):
                audit.append(edit)
                if edit != "D":
                    digest.update(f"{chr(10) * any_turn}{role}:{text}".encode("utf-8", "surrogatepass"))
                    any_turn = True
            done.append((held.key, held.gaps(), held.blank, held.duplicate, held.truncated, held.illegal, cost, "".join(audit), digest.hexdigest()))
            if len(done) >= 1024:
                yield pd.DataFrame(done, columns=names)
                done = []
        if done:
            yield pd.DataFrame(done, columns=names)

    return _streamed(turns).mapInPandas(run, _AUDIT).select(F.when(F.col("key") != "", F.col("key").cast("long")).alias("conv_id"), *names[1:])


def repairs(turns: DataFrame, spool: int = SPOOL) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired turns, from 0; edit is K, R or I."""
    names = ["key", "position", "edit", "role", "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, size = [], 0
        for held in _conversations(frames, spool):
            _, chosen, inserts = held.edits()
            stay = (t for t in held.repaired(chosen, inserts) if t[0] != "D")
            for position, (edit, role, text) in enumerate(stay):
                done.append((held.key, position, edit, role, text))
                size += len(text)
                if len(done) >= 1024 or size > spool:
                    yield pd.DataFrame(done, columns=names)
                    done, size = [], 0
        if done:
            yield pd.DataFrame(done, columns=names)

    return _streamed(turns).mapInPandas(run, "key string, position long, edit string, role string, text string").select(F.when(F.col("key") != "", F.col("key").cast("long")).alias("conv_id"), *names[1:])
