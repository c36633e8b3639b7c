"""Interval joins by dyadic bins, and what holds at an instant.

An interval has a level, the least power of four (in microseconds) that is as long as it is, and lies in the one, two or
three bins of its level that it touches. Two intervals that share time share the bin, of the longer one's level, in which
the later of them starts; so each pair is met there once, and an equal join on (key, level, bin) finds all. A shorter
interval looks at the levels that occur above its own, forty at most. Work is dealt by bin, not by key: one key with most
of the intervals spreads over all tasks, and what a bin holds beyond its pairs is of the same stretch of time.

Intervals are half open, [start, end); null bounds are open, which the least and greatest time that occurs stand for. Those
that end by their start are empty and meet nothing. Null keys meet nothing; repeated intervals are intervals of their own
if their ids differ. Times are timestamps (or what casts to them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rules import valid_at
from ..session import settled

#: Least level, as a power of two of microseconds: about four seconds.
LEAST = 22


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def binned(rows: DataFrame, start: str, end: str, bounds: tuple[int, int]) -> DataFrame:
    """rows with __from and __to (microseconds, open bounds set past those of all) and __level; empty ones are left out."""
    low, high = bounds
    held = rows.where(F.coalesce(F.col(end) > F.col(start), F.lit(True)))
    held = held.withColumn("__from", F.coalesce(_micros(start), F.lit(low - 1))).withColumn("__to", F.coalesce(_micros(end), F.lit(high + 1)))
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("__to") - F.col("__from"), F.lit(1)).cast("double")) / 2) * 2, F.lit(LEAST))
    return held.where("__to > __from").withColumn("__level", level.cast("int"))


def _bounds(*sides: tuple[DataFrame, str, str]) -> tuple[int, int]:
    """The least and the greatest time of all."""
    found = [v for rows, a, b in sides for v in rows.agg(F.min(_micros(a)), F.max(_micros(a)), F.min(_micros(b)), F.max(_micros(b))).first() if v is not None]
    return (min(found), max(found)) if found else (0, 0)


def _levels(held: DataFrame):
    """The levels that occur, forty at most, as an array."""
    found = [str(r[0]) for r in held.select("__level").distinct().orderBy("__level").collect()]
    return F.expr(f"cast(array({', '.join(found)}) as array<int>)")


def meeting(intervals: DataFrame, by: str, owner: str, start: str, end: str, key: str) -> DataFrame:
    """(by, a, b): the pairs of intervals (ids of `key`) of one `by` and different owners that share time, each pair once."""
    rows = intervals.select(F.col(by).alias("by"), F.col(owner).alias("owner"), F.col(key).alias("key"), F.col(start).alias("start"), F.col(end).alias("end")).where("by is not null")
    held = binned(rows, "start", "end", _bounds((rows, "start", "end")))
    held = settled(held.select("by", "owner", "key", F.col("__from").alias("s"), F.col("__to").alias("e"), F.col("__level")))
    levels = _levels(held)
    held = held.withColumnRenamed("__level", "level")
    at = F.explode(F.expr("sequence(shiftright(s, level), shiftright(e - 1, level))"))
    long_ = held.withColumn("bin", at).select("by", "level", "bin", F.col("owner").alias("lo"), F.col("key").alias("lk"), F.col("s").alias("ls"), F.col("e").alias("le"))
    short = held.withColumnRenamed("level", "own").withColumn("level", F.explode(F.filter(levels, lambda v: v >= F.col("own")))).withColumn("bin", at)
    met = short.join(long_, ["by", "level", "bin"]).where("owner != lo and s < le and ls < e and bin = shiftright(greatest(s, ls), level)")
    # Of two of one level either is the shorter one once.
    met = met.where("own < level or key < lk")
    return met.select(F.col("by").alias(by), F.least("key", "lk").alias("a"), F.greatest("key", "lk").alias("b"))


def holding(points: DataFrame, intervals: DataFrame, by: str, at: str, start: str, end: str) -> DataFrame:
    """points joined with the intervals of their `by` that hold their time; columns of both, with one `by`.

    A point without a time is held by intervals that are open at both ends only.
    """
    low, high = _bounds((intervals, start, end), (points, at, at))
    held = settled(binned(intervals.where(F.col(by).isNotNull()), start, end, (low, high)))
    levels = _levels(held)
    long_ = held.withColumn("__bin", F.explode(F.expr("sequence(shiftright(__from, __level), shiftright(__to - 1, __level))"))).drop("__from", "__to")
    asked = points.where(F.col(at).isNotNull()).withColumn("__t", _micros(at)).withColumn("__level", F.explode(levels)).withColumn("__bin", F.expr("shiftright(__t, __level)"))
    found = asked.join(long_, [by, "__level", "__bin"]).where(valid_at(F.col(start), F.col(end), F.col(at))).drop("__t", "__level", "__bin")
    always = intervals.where(F.col(start).isNull() & F.col(end).isNull())
    return found.unionByName(points.where(F.col(at).isNull()).join(always, by).select(*found.columns))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(at, node, component): of edges (at, a, b), apart for each `at`, the least node that each node is joined to.

    In each round a node's larger neighbours and then its smaller ones are hooked to the least; it ends when nothing
    changes, after a number of rounds that grows with the logarithm of the longest chain.
    """
    e = settled(edges.select("at", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    sign = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("at", "a", "b").cast("decimal(38,0)"))).first())
    before = sign(e)
    for _ in range(most_rounds):
        both = e.union(e.select("at", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("at", "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, ["at", "a"]).select("at", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("at", "a").agg(F.min("b").alias("m"))
        small = large.join(least, ["at", "a"])
        e = settled(small.select("at", F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("at", "a", F.col("m").alias("b"))).where("a != b").distinct())
        now = sign(e)
        if now == before:
            roots = e.select("at", F.col("b").alias("node"), F.col("b").alias("component"))
            return e.select("at", F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def connected(links: DataFrame, instants: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """(at, account, person_group): which accounts are one person at each of the instants (at).

    links (account, person, status, valid_from, valid_to, record_id): those count that are confirmed, hold at the instant
    and rest on a record that is not hidden (record_id). Accounts are one person if they share persons, over any number of
    steps; the group is named by its least account. A revoked link counts at no instant, before its revocation or after.
    """
    firm = links.where("status = 'confirmed'")
    if hidden is not None:
        firm = firm.join(hidden.select("record_id").distinct(), "record_id", "left_anti")
    asked = instants.select("at").where("at is not null").distinct().withColumn("__all", F.lit(0))
    firm = firm.select("account", "person", "valid_from", "valid_to").where("account is not null and person is not null")
    held = holding(asked, firm.withColumn("__all", F.lit(0)), "__all", "at", "valid_from", "valid_to")
    # Persons sort behind accounts, so that an account names each group.
    edges = held.select("at", F.concat(F.lit("a"), "account").alias("a"), F.concat(F.lit("p"), "person").alias("b"))
    found = components(edges).where(F.col("node").startswith("a"))
    return found.select("at", F.substring("node", 2, 1 << 20).alias("account"), F.substring("component", 2, 1 << 20).alias("person_group"))
