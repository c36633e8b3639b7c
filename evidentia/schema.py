"""The record contract: its columns, and checks as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

PARTICIPANT = T.StructType([T.StructField(n, T.StringType()) for n in ("namespace", "address", "label", "relation")])
PROVENANCE = T.StructType([*(T.StructField(n, T.StringType()) for n in ("connector_id", "connector_version", "source_locator", "origin")), T.StructField("parent_record_ids", T.ArrayType(T.StringType()))])
RECORD = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("schema_version", "source", "source_id", "revision", "kind", "occurred_at", "observed_at", "text")),
        T.StructField("participants", T.ArrayType(PARTICIPANT)),
        T.StructField("provenance", PROVENANCE),
    ]
)
# The greatest lengths of the contract's texts, in characters.
LENGTHS = {"source": 200, "source_id": 1000, "revision": 200, "kind": 100, "text": 100_000}
ORIGINS = ("source", "assistant", "derived")
#: An instant with its zone.
INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def failures(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, in order; an unknown one does not."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))


def instant(text: Column | str) -> Column:
    """A zoned time as an instant; null if it has no zone or is none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(INSTANT), F.try_to_timestamp(text))


def record_errors() -> Column:
    """What is wrong with a record of the contract."""
    blank = {f"{n}_missing": F.col(n).isNull() | (F.trim(n) == "") for n in LENGTHS}
    long = {f"{n}_long": F.length(n) > most for n, most in LENGTHS.items()}
    parents = F.coalesce(F.col("provenance.parent_record_ids"), F.array().cast("array<string>"))
    rest = {
        "schema_version": F.coalesce(F.col("schema_version") != "1.0", F.lit(True)),
        "occurred_at": F.col("occurred_at").isNotNull() & instant("occurred_at").isNull(),
        "observed_at": instant("observed_at").isNull(),
        "participants_many": F.size("participants") > 1000,
        "origin": F.coalesce(~F.col("provenance.origin").isin(*ORIGINS), F.lit(True)),
        "parents_repeated": F.size(F.array_distinct(parents)) < F.size(parents),
        "parents_many": F.size(parents) > 100,
        "parents_missing": (F.col("provenance.origin") == "derived") & (F.size(parents) == 0),
    }
    return failures(blank | long | rest)


def validated(records: DataFrame) -> DataFrame:
    """records with errors and valid."""
    return records.withColumn("errors", record_errors()).withColumn("valid", F.size("errors") == 0)


# The records and bytes that a batch may have.
BATCH_RECORDS, BATCH_BYTES = 100, 1 << 20


def judged_batches(records: DataFrame, batch: str, bad: Column, size: Column) -> DataFrame:
    """records with `refused`, why their batch is: a bad record, more than BATCH_RECORDS, or more than BATCH_BYTES; else null."""
    marked = records.withColumn("__bad", bad).withColumn("__size", size.cast("long"))
    each = marked.groupBy(batch).agg(F.count("*").alias("__n"), F.bool_or("__bad").alias("__any"), F.sum("__size").alias("__bytes"))
    why = F.when(F.col("__any"), "record").when(F.col("__n") > BATCH_RECORDS, "count").when(F.col("__bytes") > BATCH_BYTES, "bytes")
    return marked.drop("__bad", "__size").join(each, batch).withColumn("refused", why).drop("__n", "__any", "__bytes")
