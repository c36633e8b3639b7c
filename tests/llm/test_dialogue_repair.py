"""Conversation repair against a search over all repairs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

from evidentia.llm import queries
from evidentia.llm.dialogue_repair import audits, repairs

KIND = "conv_id long, turn long, role string, text string, audit int, absent boolean"


def faults(rows):
    """(initial, fault) of each row (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        shown = re.findall("[^\x20\x09-\x0d]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def cheapest(rows):
    """(cost, edits, repaired turns), by trying every edit at every row; at most two insertions stand in a row."""
    marked = faults(rows)

    @lru_cache(maxsize=None)
    def best(i, before, inserted):
        # before: the initials so far, as far as they matter: "" nothing, then the last one.
        out = []
        if i == len(rows) and before in ("", "a"):
            out.append((0, "", ()))
        wanted = "assistant" if before == "u" else "user"
        if inserted < 2:
            c, e, t = best(i, wanted[0], inserted + 1)
            out.append((c + 2, "I" + e, (f"{wanted}:", *t)))
        if i < len(rows):
            initial, fault = marked[i]
            c, e, t = best(i + 1, before, 0)
            out.append((c + 3, "D" + e, t))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                c, e, t = best(i + 1, wanted[0], 0)
                out.append((c + 2 + more, "R" + e, (f"{wanted}:{rows[i][1]}", *t)))
                if initial == wanted[0] or (initial == "s" and before == ""):
                    c, e, t = best(i + 1, initial, 0)
                    out.append((c + more, "K" + e, (f"{rows[i][0]}:{rows[i][1]}", *t)))
        return min(out) if out else (10**9, "~", ())

    return best(0, "", 0)


def told(rows):
    """What audits() gives for rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    cost, edits, turns = cheapest([r[1:] for r in rows])
    marked = [f for _, f in faults([r[1:] for r in rows])]
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, marked.count("blank"), marked.count("duplicate"), marked.count("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def test_random_conversations(spark):
    rng = random.Random(3)
    texts = ["Good.", "good", "Well!", " ", "", "odd\n", "is it? ", "ü."]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "uber", ""]) if c % 2 else rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(400) for _ in range(rng.randrange(1, 9))]
    held = defaultdict(list)
    for c, *row in rows:
        held[c].append(tuple(row))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: tuple(r)[1:] for r in audits(frame).collect()}
    assert found == {c: told(own) for c, own in held.items()}
    assert {r.conv_id: tuple(r)[1:] for r in audits(frame, spool=16).collect()} == found
    lines = defaultdict(list)
    for r in sorted(repairs(frame, spool=16).collect(), key=lambda r: (r.conv_id, r.position)):
        lines[r.conv_id].append(r)
    for c, own in found.items():
        assert "".join(r.edit for r in lines[c]) == own[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines[c]).encode()).hexdigest() == own[7]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in lines[c]))


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in queries.op12_dialogue_repair(spark, sf_dir).collect()}
    assert found == {c: told(own) for c, own in damaged(rows).items()}
    assert sum(r[5] for r in found.values()) > 0


def test_dropped_nulls_and_extra_columns(spark):
    none = hashlib.sha256(b"").hexdigest()
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x."), (None, None, None, None), (None, 1, "user", "Hi."), (5000, None, "user", "a"), (5000, 3, "assistant", None), (5001, 2, "s", "x" * 300_000)]
    frame = spark.createDataFrame([(*r, 1, None) for r in rows], KIND)
    found = {r.conv_id: tuple(r)[1:] for r in audits(queries.damaged_turns(frame)).collect()}
    assert found == {c: told(own) for c, own in damaged(rows).items()}
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", none)
    assert audits(frame.limit(0)).count() == 0 and repairs(frame.limit(0)).count() == 0
    assert audits(frame).count() == 4


def test_giant_conversation(spark):
    """Far more rows than a batch or the spool holds."""
    rng = random.Random(1)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), f"row {i}{rng.choice(['.', '!', ''])}" if rng.random() < 0.9 else "") for i in range(30_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    small, large = (audits(frame, spool=n).first() for n in (1000, 64 << 20))
    assert small == large and len(small.audit.replace("I", "")) == 30_000
    turns = sorted(repairs(frame, spool=1000).collect(), key=lambda r: r.position)
    assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in turns))
    price = {"K": 0, "I": 2, "R": 2, "D": 3}
    late = sum(r.edit in "KR" and r.text[-1] not in ".!?" for r in turns)
    assert small.cost == sum(price[e] for e in small.audit) + late
