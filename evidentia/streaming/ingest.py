"""Streaming ingestion: batches enter an append-only store once, in whatever order and however often they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["source", "source_id", "revision"]
#: Parts of the store by hash of the identity: a batch reads those parts only that its own identities fall to.
PARTS = 256


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The store, or an empty one where nothing was written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def accept(batch: DataFrame, batch_id: int, store: str) -> None:
    """Appends a batch's new records, with their status; a batch that ran before is replaced by itself.

    A batch has its own folder (partition batch_id), so a retry after a lost driver writes the same rows again. Known
    identities are looked up in earlier batches only, and there in the parts that the batch's own fall to. Of equal
    identities within a batch the least digest is kept.
    """
    spark = batch.sparkSession
    digest = F.sha2(F.to_json(F.struct(*sorted(c for c in batch.columns if c not in KEY))).cast("binary"), 256)
    fresh = batch.withColumn("fingerprint", digest).withColumn("part", F.pmod(F.xxhash64(*KEY), F.lit(PARTS)).cast("int"))
    first = fresh.groupBy(*KEY).agg(F.min("fingerprint").alias("fingerprint"))
    fresh = fresh.join(first, [*KEY, "fingerprint"], "left_semi").dropDuplicates(KEY)
    schema = fresh.drop("part").withColumn("status", F.lit("")).withColumn("batch_id", F.lit(0).cast("long")).withColumn("part", F.lit(0)).schema
    parts = [r.part for r in fresh.select("part").distinct().collect()]
    known = _read(spark, store, schema).where((F.col("batch_id") < batch_id) & F.col("part").isin(parts) & (F.col("status") == "new"))
    known = known.select(*KEY, F.col("fingerprint").alias("__known"))
    status = F.when(F.col("__known").isNull(), "new").when(F.col("__known") == F.col("fingerprint"), "duplicate").otherwise("conflict")
    out = fresh.join(known, KEY, "left").withColumn("status", status).drop("__known")
    out.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch_id={batch_id}")


def ingest(records: DataFrame, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs a stream of contract records into the store."""
    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: accept(batch, i, store))
    return (writer.trigger(availableNow=True) if once else writer).start()


def accepted(spark: SparkSession, store: str, schema) -> DataFrame:
    """The store's current records: one for each identity."""
    return _read(spark, store, schema).where("status = 'new'")
