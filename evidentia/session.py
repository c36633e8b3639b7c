"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "evidentia", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; conf adds or overrides settings."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    return builder.config(map=settings | conf).getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed in the cluster's shared folder (spark.checkpoint.dir; where unset, a fresh one, in local mode only)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="evidentia-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table for each core under which a scan may have fewer row groups than there are cores.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is so small that a few tasks would read it all, for work that costs more than a shuffle.

    What is moved is bounded by the number of cores; a larger table is read as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df
