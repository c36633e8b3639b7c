"""The change journal and the sweeps of its consumers as stateful streams.

State is kept by key in the RocksDB state store, checkpointed in the stream's folder: a restart goes on where the last
committed micro-batch ended. Within a micro-batch the rows of one key are put in order and held in memory; what a trigger
takes in bounds them. Rows that come in a later micro-batch are later, whatever their order says.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.awareness import Packing

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that there is into files below `folder`, and reads them."""
    spark = stream.sparkSession
    with rocksdb(spark):
        written = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/rows")
        written.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


class Transitions(StatefulProcessor):
    """Each item's kind of change and version: what `journal.transitions` gives, whatever the micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string, metadata string, live boolean, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("order", kind="stable")
        known = self.last.exists()
        digest, metadata, live, version = self.last.get() if known else (None, None, False, 0)
        out = []
        plain = lambda v: None if pd.isna(v) else v
        for order, d, m, role, arrival in zip(frame["order"], frame.digest.map(plain), frame.metadata.map(plain), frame.role.map(plain), frame.arrival.map(plain), strict=True):
            kind = "created" if not known else "content_updated" if d != digest else "metadata_updated" if m != metadata else "unchanged"
            refined = kind == "unchanged" and arrival == "fresh" and role == "incremental" and not live
            kind = "created" if refined else kind
            version += kind != "unchanged"
            known, digest, metadata, live = True, d, m, live or role != "backfill"
            out.append((key[0], order, kind, version, refined))
        self.last.update((digest, metadata, bool(live), int(version)))
        yield pd.DataFrame(out, columns=["item", "order", "kind", "transition_version", "refinement"])

    def close(self) -> None:
        pass


def journalled(log: DataFrame, item: str, order: str, digest: str, metadata: str | None = None, role: str | None = None, arrival: str | None = None) -> DataFrame:
    """(item, order, kind, transition_version, refinement) of a stream of operations; one without a role is live."""
    text = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    rows = log.select(F.col(item).alias("item"), F.col(order).cast("long").alias("order"), text(digest).alias("digest"), text(metadata).alias("metadata"), text(role).alias("role"), text(arrival).alias("arrival"))
    schema = f"item {rows.schema['item'].dataType.simpleString()}, order long, kind string, transition_version long, refinement boolean"
    return rows.groupBy("item").transformWithStateInPandas(Transitions(), schema, "append", "none")


class Sweep(StatefulProcessor):
    """A consumer's cursor and its events since; a timer at the end of each window freezes them into batches."""

    def __init__(self, width: int, cap: int, budget: int):
        self.width, self.cap, self.budget = width, cap, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "seq long")
        # Open events by the end of their window (ms), in blocks as they came: a call of the state store for each, not for each event.
        self.open = handle.getMapState("open", "until long, n int", "seq array<long>, kind array<string>, grp array<string>, chars array<long>")
        self.sizes = handle.getMapState("sizes", "until long", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            blocks: dict[int, list[tuple]] = {}
            for until, seq, *rest in zip(*(frame[c].tolist() for c in ("until", "seq", "kind", "grp", "chars")), strict=True):
                if not pd.isna(until):
                    blocks.setdefault(int(until), []).append((None if pd.isna(seq) else int(seq), *rest))
            for until, events in blocks.items():
                n = (self.sizes.getValue((until,)) or (0,))[0]
                if not n:
                    self.handle.registerTimer(until)
                self.open.updateValue((until, n), tuple(map(list, zip(*events, strict=True))))
                self.sizes.updateValue((until,), (n + 1,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        n = self.sizes.getValue((until,))[0]
        events = [e for i in range(n) for e in zip(*self.open.getValue((until, i)), strict=True)]
        last = lambda s: (s is None, s or 0)
        first: dict[tuple, int | None] = {}
        for seq, kind, grp, _ in events:
            first[kind, grp] = min(seq, first.get((kind, grp), seq), key=last)
        events.sort(key=lambda e: (last(first[e[1], e[2]]), e[1], e[2], last(e[0]), e[3]))
        rule = Packing(self.cap, self.budget)
        parts = [rule.add((key[0], kind, grp), chars) for _, kind, grp, chars in events]
        rule.close()
        for i in range(n):
            self.open.removeKey((until, i))
        self.sizes.removeKey((until,))
        known = (self.cursor.get() or (None,))[0]
        cursor = max((s for s in (known, *(e[0] for e in events)) if s is not None), default=None)
        self.cursor.update((cursor,))
        yield pd.DataFrame({"consumer": key[0], "until": until, "seq": pd.array([e[0] for e in events], "Int64"), "batch": [rule.batch_of[p] for p in parts], "cursor": pd.array([cursor] * len(events), "Int64")})

    def close(self) -> None:
        pass


def sweeps(events: DataFrame, consumer: str, kind: Column, group: str, seq: str, size: str, at: str, width: int, cap: int, budget: int, late: str = "0 seconds", second: Column | None = None) -> DataFrame:
    """(consumer, until, seq, batch, cursor): the batches of each consumer's events in each window of `width` seconds of
    event time, frozen once the stream has passed the window's end (until, in ms) by `late`; later ones are dropped.

    Batches are those of `awareness.swept` within a window, whatever the micro-batches. `second`, where given, is the whole
    second that tells an event's window.
    """
    ms = F.unix_millis(F.col(at).cast("timestamp"))
    until = (F.floor(ms / (1000 * width) if second is None else second / width) + 1) * (1000 * width)
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).select(F.col(consumer).alias("consumer"), F.col(at), until.cast("long").alias("until"), F.col(seq).cast("long").alias("seq"), kind.cast("string").alias("kind"), F.col(group).cast("string").alias("grp"), F.col(size).cast("long").alias("chars"))
    schema = f"consumer {rows.schema['consumer'].dataType.simpleString()}, until long, seq long, batch long, cursor long"
    return rows.groupBy("consumer").transformWithStateInPandas(Sweep(width, cap, budget), schema, "append", "eventtime")
