"""The change journal: transitions, versions and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def transitions(log: DataFrame, item: str, order: str, digest: str, metadata: str | None = None, role: str | None = None, arrival: str | None = None) -> DataFrame:
    """log with kind and the item's transition_version among its real changes.

    kind: created; content_updated where the digest changed; metadata_updated where only `metadata` did; unchanged. With
    `role` and `arrival` also `refinement`: a fresh arrival of an incremental stream that finds its content stored already,
    by backfills only, is told as created once more.
    """
    by = Window.partitionBy(item).orderBy(order)
    same = lambda c: F.col(c).eqNullSafe(F.lag(c).over(by))
    kind = F.when(F.row_number().over(by) == 1, "created").when(~same(digest), "content_updated")
    if metadata:
        kind = kind.when(~same(metadata), "metadata_updated")
    kinds = log.withColumn("kind", kind.otherwise("unchanged"))
    if role and arrival:
        live = F.max(F.coalesce(F.col(role) != "backfill", F.lit(True))).over(by.rowsBetween(Window.unboundedPreceding, -1))
        fine = (F.col("kind") == "unchanged") & (F.col(arrival) == "fresh") & (F.col(role) == "incremental") & ~live
        kinds = kinds.withColumn("refinement", F.coalesce(fine, F.lit(False))).withColumn("kind", F.when(F.col("refinement"), "created").otherwise(F.col("kind")))
    return kinds.withColumn("transition_version", F.sum(F.when(F.col("kind") != "unchanged", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def event_ids(log: DataFrame, *parts: str) -> DataFrame:
    """log with event_id: evt_ and a digest of what tells an event apart, so that an event appended twice is one."""
    return log.withColumn("event_id", F.concat(F.lit("evt_"), F.substring(F.sha2(F.to_json(F.array(*(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))), 256), 1, 32)))


def feed(log: DataFrame, consumer: str, order: str, size: str, budget: int, limit: int) -> DataFrame:
    """One page of a feed for each consumer: events in order while their sizes fit the budget, the first one always."""
    by = Window.partitionBy(consumer).orderBy(order)
    first = log.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= limit)
    used = first.withColumn("__used", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return used.where((F.col("__used") <= budget) | (F.col("__n") == 1)).drop("__n", "__used")


def page(log: DataFrame, cursors: DataFrame, consumer: str, order: str, size: str, budget: int, limit: int, wanted: Column, kept_from: int = 0) -> DataFrame:
    """The next page of each consumer's feed: wanted events past its cursor (consumer, cursor), as `feed` cuts them, and
    `resync`, whether what lies between the cursor and the page is no longer kept.
    """
    past = log.where(wanted).join(cursors, consumer).where(F.col(order) > F.col("cursor"))
    return feed(past, consumer, order, size, budget, limit).withColumn("resync", F.col("cursor") < kept_from).drop("cursor")
