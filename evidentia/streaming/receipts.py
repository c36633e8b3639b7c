"""Receipts of ingested batches: a commit log in which a checkpoint moves by compare and set, with replays and conflicts told apart.

A batch of records comes with a checkpoint: who sends it (connector, source), the cursor it expects and the one it moves
to. It is

- committed, if the stored cursor is the expected one;
- replayed, if the stored cursor is the new one already and the batch is the same: nothing is written, the outcome is told again;
- refused, if the new cursor was committed with another batch (Reused), or the stored cursor is neither (Stale).

The log is made of immutable parts (see `operators.parts`): each commit writes what it added and its receipt, then the row
that makes both count, so a batch that breaks off leaves nothing behind. One writer is taken to run at a time, as a stream
has one driver. Identities lie in PARTS folders by hash, and every MERGE commits they are written anew as one base: a
batch reads at most MERGE + 1 files for each folder that its own identities fall to, however large the store has grown. A
receipt of each sender is carried over. Records with equal identities within a batch count once, by the least digest. Null parts of
an identity are equal to each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.parts import Parts

KEY = ["source", "source_id", "revision"]
PARTS, MERGE = 64, 16
_IDENTITIES = "source string, source_id string, revision string, fingerprint string, part int"
_RECEIPTS = "connector string, scope string, cursor string, batch_hash string, added long, repeated long, conflicts long, number long"


class Stale(ValueError):
    """Another consumer moved the checkpoint."""


class Reused(ValueError):
    """A committed checkpoint came with another batch."""


class Ledger:
    """The log below `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, merge: int = MERGE):
        self.spark, self.parts, self.merge_after = spark, Parts(spark, root), merge

    def receipts(self) -> DataFrame:
        """Receipts since the last merge, and of each sender its last."""
        return self.parts.read("receipts", _RECEIPTS)

    def checkpoint(self, connector: str, source: str):
        """The last receipt of a sender, or None."""
        mine = self.receipts().where((F.col("connector") == connector) & (F.col("scope") == source))
        return mine.orderBy(F.desc("number")).first()

    def known(self, keyed: DataFrame) -> DataFrame:
        """The stored identities that those of keyed (KEY, part) may be equal to: of the base, their folders only."""
        folders = [r.part for r in keyed.select("part").distinct().collect()]
        return self.parts.read("identities", _IDENTITIES).where(F.col("part").isin(folders))

    def commit(self, records: DataFrame, connector: str, source: str, expected: str | None, cursor: str) -> dict:
        """Adds a batch of records (KEY and others); {"replayed", "added", "repeated", "conflicts"}, or an error."""
        if records.where(~F.col("source").eqNullSafe(F.lit(source))).limit(1).count():
            raise ValueError("the checkpoint's source must be that of every record")
        rest = sorted(c for c in records.columns if c not in KEY)
        content = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).cast("binary"), 256) if rest else F.lit("")
        rows = records.select(*KEY, content.alias("fingerprint")).groupBy(*KEY).agg(F.min("fingerprint").alias("fingerprint"))
        rows = rows.withColumn("part", F.pmod(F.xxhash64(*KEY), F.lit(PARTS)).cast("int"))
        # Of all rows, in whatever order and however often they are read: two sums of hashes and their number.
        hashes = records.select(F.xxhash64(*KEY, content).alias("a"), F.xxhash64(F.lit(1), *KEY, content).alias("b"))
        shape = hashes.agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b")).first()
        digest = f"{shape.n}:{shape.a}:{shape.b}"
        last = self.checkpoint(connector, source)
        held = None if last is None else last.cursor
        if held == cursor and last is not None:
            if last.batch_hash != digest:
                raise Reused(f"{cursor} was committed with another batch")
            return {"replayed": True, "added": last.added, "repeated": last.repeated, "conflicts": last.conflicts}
        if held != expected:
            raise Stale(f"the stored cursor is {held}, not {expected}")
        batch = self.parts.next_batch()
        known = self.known(rows).select(*(F.col(c).alias(f"__{c}") for c in KEY), F.col("fingerprint").alias("__known"))
        same = F.lit(True)
        for c in KEY:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        judged = rows.join(known, same, "left")
        counts = judged.agg(F.count(F.when(F.col("__known").isNull(), 1)).alias("added"), F.count(F.when(F.col("__known") == F.col("fingerprint"), 1)).alias("repeated"), F.count("*").alias("n")).first()
        outcome = {"added": counts.added, "repeated": counts.repeated, "conflicts": counts.n - counts.added - counts.repeated}
        self.parts.write(judged.where("__known is null").select(*KEY, "fingerprint", "part").coalesce(1), "identities", batch, "part")
        receipt = self.spark.createDataFrame([(connector, source, cursor, digest, *outcome.values(), batch)], _RECEIPTS)
        self.parts.write(receipt.coalesce(1), "receipts", batch)
        self.parts.commit(batch, base=not self.parts.commits(), records=counts.added)
        if len(self.parts.commits()) > self.merge_after:
            self.merge()
        return {"replayed": False, **outcome}

    def merge(self) -> None:
        """Identities as one base of a folder for each part, and the last receipt of each sender."""
        batch = self.parts.next_batch()
        total = self.parts.figure("records")
        every = self.parts.read("identities", _IDENTITIES).drop("batch")
        self.parts.write(every.repartition("part"), "identities", batch, "part")
        last = self.receipts().groupBy("connector", "scope").agg(F.max_by(F.struct("cursor", "batch_hash", "added", "repeated", "conflicts", "number"), "number").alias("r"))
        self.parts.write(last.select("connector", "scope", "r.*").coalesce(1), "receipts", batch)
        self.parts.commit(batch, base=True, records=total)
