"""Consumers of the change journal: what they have still to read, batches, packets, retention and results.

Two rules are sequential within a consumer: how events are cut into batches, and which groups fit a packet. There rows
come sorted and are streamed; a task holds a few numbers and the events of one open part, which a budget bounds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

# Groups and characters of a packet and of a background batch.
PACKET_GROUPS, PACKET_CHARS, BACKGROUND_GROUPS, BACKGROUND_CHARS = 8, 4000, 20, 24_000


def event_chars(payload: str, refs: str):
    """What an event counts in a budget: its JSON and its first eight references, 500 at least."""
    return F.greatest(F.lit(500), F.length(payload) + 150 * F.least(F.col(refs), F.lit(8)))


class Packing:
    """The rule of batches, one event after the other: `part` numbers parts, `batch_of` the batches of the closed ones."""

    def __init__(self, cap: int, budget: int):
        self.cap, self.budget, self.batch_of = cap, budget, []
        self.whole, self.count, self.chars = None, 0, 0
        self._restart()

    def _restart(self) -> None:
        self.batch, self.held, self.used, self.sort = -1, 0, 0, None

    def add(self, key: tuple, size: int) -> int:
        """The number of the part that an event of group key (consumer, kind..., group) belongs to."""
        if key != self.whole or (self.count and self.chars + size > self.budget):
            self.close()
            if self.whole is None or key[0] != self.whole[0]:
                self._restart()
            self.whole = key
        self.count, self.chars = self.count + 1, self.chars + size
        return len(self.batch_of)

    def close(self) -> None:
        """Ends the open part and puts it into the open batch or the next."""
        if not self.count:
            return
        if self.batch < 0 or self.sort != self.whole[1:-1] or self.held + 1 > self.cap or self.used + self.chars > self.budget:
            self.batch, self.held, self.used, self.sort = self.batch + 1, 0, 0, self.whole[1:-1]
        self.held, self.used = self.held + 1, self.used + self.chars
        self.batch_of.append(self.batch)
        self.count, self.chars = 0, 0


def swept(events: DataFrame, consumer: str, kind: list[str], group: str, seq: str, size: str, cap: int, budget: int) -> DataFrame:
    """events with `batch`, a number in the consumer's order of batches.

    Groups (kind..., group) come in the order of their first event. A group is cut into parts that keep to the budget; a
    part joins the open batch if both are of one kind and the batch then holds at most cap parts and budget characters.
    An event over the budget is a part of its own. The events of one consumer are one sequence and so
    one task's, which holds no more of them than an Arrow batch and an open part.
    """
    own = [consumer, *kind, group]
    first = F.min(seq).over(Window.partitionBy(*own))
    dealt = events.withColumn("__first", first).repartition(consumer).sortWithinPartitions(consumer, "__first", *kind, group, seq)
    names = list(events.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, open_rows = Packing(cap, budget), None

        def told(rows: pa.Table, parts: list[int]) -> Iterator[pa.RecordBatch]:
            found = rows.append_column("batch", pa.array([rule.batch_of[p] for p in parts], pa.int64()))
            yield from found.combine_chunks().to_batches()

        for held in batches:
            rows = pa.Table.from_batches([held]).select(names)
            parts = [rule.add(key, n) for key, n in zip(zip(*(rows.column(c).to_pylist() for c in own), strict=True), rows.column(size).to_pylist(), strict=True)]
            if open_rows is not None:
                rows, parts = pa.concat_tables([open_rows[0], rows]), open_rows[1] + parts
            done = bisect_left(parts, len(rule.batch_of))
            if done:
                yield from told(rows.slice(0, done), parts[:done])
            # Numbers of parts start anew, so that a task's list of them stays short.
            open_rows, rule.batch_of = (rows.slice(done), [0] * (len(parts) - done)), []
        rule.close()
        if open_rows is not None and open_rows[0].num_rows:
            yield from told(*open_rows)

    return dealt.mapInArrow(run, T.StructType([*events.schema.fields, T.StructField("batch", T.LongType())]))


def fitted(groups: DataFrame, by: str, order: str, size: str, most: int, budget: int) -> DataFrame:
    """The skip rule: in order, each group that fits what is left of the budget, `most` at most; others are passed over."""
    names = list(groups.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, used = None, 0, 0
        for frame in frames:
            taken = []
            for k, n in zip(frame[by], frame[size], strict=True):
                if k != key:
                    key, held, used = k, 0, 0
                fits = held < most and used + n <= budget
                held, used = held + fits, used + n * fits
                taken.append(fits)
            yield frame[names][taken]

    return groups.repartition(by).sortWithinPartitions(by, order).mapInPandas(run, groups.schema)


def packets(groups: DataFrame, exposed: DataFrame, session: str, key: str, order: str, size: str) -> DataFrame:
    """Each session's packet: its groups that were not exposed to it before, as far as they fit."""
    fresh = groups.join(exposed.select(session, key).distinct(), [session, key], "left_anti")
    return fitted(fresh, session, order, size, PACKET_GROUPS, PACKET_CHARS)


def pending(consumers: DataFrame, batches: DataFrame, log: DataFrame, now) -> DataFrame:
    """(consumer, claimable, unscanned, pending): whether a run of a consumer (consumer, cursor, epoch, resync) is worth
    while, from aggregates of its batches (consumer, epoch, state, until) and of the log (epoch, seq).
    """
    from .recall import claimable

    free = batches.where(claimable(F.col("state"), F.col("until"), now)).select("consumer", "epoch").distinct().withColumn("__free", F.lit(True))
    top = log.groupBy("epoch").agg(F.max("seq").alias("__top"))
    each = consumers.join(free, ["consumer", "epoch"], "left").join(top, "epoch", "left")
    claim, scan = F.coalesce("__free", F.lit(False)), F.coalesce(F.col("__top") > F.col("cursor"), F.lit(False))
    return each.select("consumer", claim.alias("claimable"), scan.alias("unscanned"), (claim | scan | F.col("resync")).alias("pending"))


def compacted(log: DataFrame, consumers: DataFrame, unfinished: DataFrame, through: int) -> tuple[DataFrame, DataFrame]:
    """What is left of a log cut through `through`, and the consumers (consumer) that must read anew: those that had not
    read or done as far, and those with unfinished batches (consumer, seq_from) from there.
    """
    late = consumers.where((F.col("cursor") < through) | (F.col("done_through") < through)).select("consumer")
    return log.where(F.col("seq") > through), late.union(unfinished.where(F.col("seq_from") <= through).select("consumer")).distinct()


def fairest(queue: DataFrame, by: str, last: str, source: str, priority: str, seq: str) -> DataFrame:
    """The next of each consumer's queue: of another source than the last one first, then by priority, then the oldest."""
    same = F.coalesce(F.col(source) == F.col(last), F.lit(False)).cast("int")
    rest = [c for c in queue.columns if c != by]
    return queue.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(same, priority, seq)).alias("r")).select(by, "r.*")


def progress(pages: DataFrame, stream: str, order: str) -> DataFrame:
    """pages (state complete, gap or pending; mode) with `event`: sync_gap where one breaks off, and for a backfill that goes
    on or ends backfill_progress or backfill_complete; null where nothing is told.
    """
    last = F.lead(order).over(Window.partitionBy(stream).orderBy(order)).isNull()
    back = F.col("mode") == "backfill"
    event = F.when(F.col("state") == "gap", "sync_gap").when(back & last & (F.col("state") == "complete"), "backfill_complete").when(back, "backfill_progress")
    return pages.withColumn("event", event)


def enrichments(results: DataFrame, log: DataFrame) -> DataFrame:
    """Events that add to others: one for each event (event_id, source, item) that a result (event_id, material) bears on."""
    kept = results.where("material").select("event_id").distinct()
    return log.join(kept, "event_id", "left_semi").select(F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", F.lit("enrichment"), F.col("event_id")), 256), 1, 24)).alias("id"), F.col("event_id").alias("cause_event_id"), "source", "item", F.lit("enrichment").alias("kind"))
