"""Stored indexes as immutable parts: what a batch of changes wrote, and a log of the batches that were committed.

An index is a folder that all executors share. A batch writes its own folders, `<table>/batch=<n>`, and then one row into
`commits/batch=<n>`: readers see committed batches only, so one that broke off is written again over what it left. Batches
are numbered from 0; one with `base` stands for all before it (a rebuild or a merge), and earlier ones are read no more.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

_COMMIT = "base boolean, figures map<string,double>"


class Parts:
    """The parts of one index below `root`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self) -> list[Row]:
        """(base, figures, batch) of the batches that count, in order; a row each, so they are few beside what they commit."""
        try:
            rows = self.spark.read.schema(f"{_COMMIT}, batch int").parquet(f"{self.root}/commits").orderBy("batch").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        first = max((i for i, r in enumerate(rows) if r.base), default=0)
        return rows[first:]

    def next_batch(self) -> int:
        return max((r.batch for r in self.commits()), default=-1) + 1

    def figure(self, name: str) -> float:
        """The sum of a figure over the batches that count."""
        return sum(r.figures[name] for r in self.commits())

    def write(self, rows: DataFrame, table: str, batch: int, *by: str) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{table}/batch={batch}")

    def commit(self, batch: int, base: bool = False, **figures: float) -> None:
        row = self.spark.createDataFrame([(base, {k: float(v) for k, v in figures.items()})], _COMMIT)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch}")

    def read(self, table: str, schema: str) -> DataFrame:
        """A table's rows of the batches that count, with `batch`."""
        batches = [r.batch for r in self.commits()]
        try:
            rows = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.root}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], f"{schema}, batch int")
        return rows.where(F.col("batch").between(batches[0], batches[-1])) if batches else rows.limit(0)
