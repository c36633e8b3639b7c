"""The corpus pipeline: documents that score toxic go, one of each near-duplicate group stays, documents that hold a
benchmark item go, secrets are replaced in the text, and what is left is packed into training sequences.

Each stage takes the documents that its predecessor kept, with the columns doc_id, text, lang, source and n_chars; all
but the last return these columns and no others, so extra columns, whatever their names, end with the first stage. Rows
that repeat a doc_id are one document from the second stage on, the least by text, lang, source and n_chars; copies are
looked for after that. A document of a null doc_id passes the filters that look ids up. Null and empty texts are kept by
every filter; texts of any length are handled whole. Empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.llm.common import cut, table
from evidentia.llm.decontaminate import contaminated
from evidentia.llm.near_dedup import near_duplicates
from evidentia.llm.packing import packed
from evidentia.llm.secret_scan import secrets
from evidentia.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; labels of all documents may be learnt from."""
    scored = toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("tox_score < 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    rows = docs.select(*COLUMNS)
    # Ids that repeat are looked for by themselves, so that no text moves where there are none.
    many = cut(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    least = rows.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    each = rows.join(many, "doc_id", "left_anti").union(least.select(*COLUMNS))
    dropped = near_duplicates(each, shingle_words=5).where("not kept").select("doc_id")
    return each.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = cut(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.select(*COLUMNS).join(found, "doc_id", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows where the text changed."""
    found = secrets(docs.select(*COLUMNS), redacted=True)
    return found.withColumn("n_chars", F.when(F.col("spans") != "", F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence of at most 4096 tokens."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: A trained classifier decides the first stage, so SQL cannot express the rows; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
