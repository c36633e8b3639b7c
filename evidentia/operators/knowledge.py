"""Knowledge tables: beliefs, conflicts, coverage, intervals, tasks and batches of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def conflicts(beliefs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Groups with more than one distinct value: the number of these and of the beliefs."""
    return beliefs.groupBy(*by).agg(F.count_distinct(value).alias("n_values"), F.count("*").alias("n_beliefs")).where("n_values > 1")


def overlapping(intervals: DataFrame, by: str, owner: str, start: str, end: str, key: str) -> DataFrame:
    """intervals with `overlaps`: how many of another owner share time with it ([start, end), null bounds being open).

    An interval meets those that start before its end, but for those that end by its start. Both numbers are running
    counts over the starts and ends of a `by` in order of time, for all owners and for its own, so no pairs are formed.
    Intervals that end by their start are empty and meet none.
    """
    ends = F.array(F.struct(F.lit(0).alias("is_start"), F.col(end).alias("t"), F.col(end).isNull().alias("never")), F.struct(F.lit(1).alias("is_start"), F.col(start).alias("t"), F.lit(False).alias("never")))
    marks = intervals.where(F.coalesce(F.col(end) > F.col(start), F.lit(True))).select(F.col(key), F.col(by), F.col(owner), F.explode(ends).alias("m")).select(key, by, owner, "m.*")
    # An open start comes first and an open end last; at one time ends come before starts.
    order = [F.col("never"), F.col("t").asc_nulls_first(), F.col("is_start")]
    past = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda kind, *keys: F.count(F.when(F.col("is_start") == kind, 1)).over(past(*keys))
    met = marks.select(key, "is_start", F.when(F.col("is_start") == 0, count(1, by) - count(1, by, owner)).otherwise(-(count(0, by) - count(0, by, owner))).alias("n"))
    counts = met.groupBy(key).agg(F.sum("n").alias("overlaps"))
    return intervals.join(counts, key, "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0).cast("long")))


def covered(required: DataFrame, states: DataFrame, domain: str, source: str) -> DataFrame:
    """(domain, n_required, n_complete, covered): whether every required source's latest state is complete."""
    held = required.join(states, source, "left").withColumn("__ok", F.coalesce(F.col("state") == "complete", F.lit(False)))
    return held.groupBy(domain).agg(F.count("*").alias("n_required"), F.count(F.when(F.col("__ok"), 1)).alias("n_complete"), F.bool_and("__ok").alias("covered"))


# The steps that a task may take.
TASK_STEPS = {
    "open": ("in_progress", "blocked", "cancelled"),
    "in_progress": ("blocked", "completed", "cancelled"),
    "blocked": ("open", "cancelled"),
}


def illegal_steps(log: DataFrame, by: str, order: list[Column], state: str, steps: dict[str, tuple[str, ...]]) -> DataFrame:
    """log with the state before and whether the step to this one is legal; the first state of a key always is."""
    before = F.lag(state).over(Window.partitionBy(by).orderBy(*order))
    allowed = F.create_map(*(x for k, v in steps.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return log.withColumn("before", before).withColumn("legal", F.col("before").isNull() | F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col(state)), F.lit(False)))


def with_dependencies(steps: DataFrame, needs: DataFrame, states: DataFrame) -> DataFrame:
    """steps (id, state) with `ready`: whether all tasks that a task needs (id, needs) are completed (id, state), and `allowed`:
    work may only begin or end on a ready task.
    """
    waiting = needs.join(states.select(F.col("id").alias("needs"), F.col("state").alias("__s")), "needs", "left").where(F.coalesce(F.col("__s") != "completed", F.lit(True)))
    open_ = waiting.select("id").distinct().withColumn("__open", F.lit(True))
    held = steps.join(open_, "id", "left").withColumn("ready", F.col("__open").isNull()).drop("__open")
    return held.withColumn("allowed", F.col("ready") | ~F.col("state").isin("in_progress", "completed"))


#: Attempts after which a task's event is set aside.
MOST_ATTEMPTS = 3


def event_states(log: DataFrame, by: str, seq: str) -> DataFrame:
    """(by, state, attempts) of events from the commands on them (claim, ack, retry), summed up before the shuffle.

    An acknowledgement after a claim delivers; else three claims set aside; else the last command tells: a claim leases, a
    retry puts back.
    """
    at = lambda name: F.when(F.col("command") == name, F.col(seq))
    each = log.groupBy(by).agg(F.count(at("claim")).alias("attempts"), F.min(at("claim")).alias("first"), F.max(at("claim")).alias("claim"), F.max(at("ack")).alias("ack"), F.max(at("retry")).alias("retry"))
    leased = F.col("claim").isNotNull() & F.coalesce(F.col("claim") > F.col("retry"), F.lit(True))
    state = F.when(F.col("ack") > F.col("first"), "delivered").when(F.col("attempts") >= MOST_ATTEMPTS, "quarantined").when(leased, "leased").otherwise("pending")
    return each.select(by, state.alias("state"), "attempts")


def current_heads(operations: DataFrame, by: list[str], version: str, seq: str) -> DataFrame:
    """The accepted operation of each item where versions are totally ordered: the greatest version, the later at a tie.

    Summed up before the shuffle, so a hot item costs a row a task.
    """
    return operations.groupBy(*by).agg(F.max(F.struct(version, seq)).alias("h")).select(*by, F.col(f"h.{version}").alias(version), F.col(f"h.{seq}").alias(seq))


def history_only(operations: DataFrame, by: list[str], version: str, seq: str) -> DataFrame:
    """operations with `late`: whether one moved nothing when it came, as an earlier one had a greater version."""
    best = F.max(version).over(Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    return operations.withColumn("late", F.coalesce(F.col(version) < best, F.lit(False)))


#: Roles of the streams that bring operations, the strongest first: of two without versions the stronger one stands.
ROLES = ("incremental", "reconcile", "backfill")


def item_states(operations: DataFrame, by: list[str]) -> DataFrame:
    """Where an item's operations (action, version, role, seq) leave it: its state, head version and the last seq that moved it.

    Of upserts and metadata updates the greatest version counts; where an item has no versions, the strongest role, then
    the latest. remove and restore move an item whatever its version, and skip moves nothing. An item that was removed is
    not revived by a backfill, but by a later upsert of another role, or a restore.
    """
    edit, gone = F.col("action").isin("upsert", "metadata_update"), F.col("action") == "remove"
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, reversed(ROLES))), F.col("role")), F.lit(0))
    back = (F.col("action") == "restore") | (edit & (F.col("role") != "backfill"))
    seq = F.col("seq")
    each = operations.where("action != 'skip'").groupBy(*by).agg(
        F.max(F.when(edit, F.struct(F.coalesce("version", F.lit(-1)).alias("version"), F.when(F.col("version").isNull(), rank).otherwise(0).alias("rank"), seq.alias("seq")))).alias("head"),
        F.max(F.when(gone, seq)).alias("removed"),
        F.max(F.when(back, seq)).alias("revived"),
    )
    live = F.col("removed").isNull() | F.coalesce(F.col("revived") > F.col("removed"), F.lit(False))
    moved = F.greatest("head.seq", "removed", F.when(F.col("removed").isNotNull(), F.col("revived")))
    return each.select(*by, F.when(live, "live").otherwise("removed").alias("state"), F.nullif("head.version", F.lit(-1)).alias("version"), moved.alias("moved_at"))
