"""Queries of the stored indexes: built, kept up by batches of changes, and probed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cells, evidence, recall, retrieval
from ..operators.postings import Postings
from ..session import table
from .registry import query
from .scans import BM25_SQL, bm25_sql

_FOUND = "SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for an index, below the cluster's shared folder; in local mode a temporary one if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="evidentia-")
    return f"{found.rstrip('/')}/indexes/{name}-{uuid.uuid4().hex}"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _told(found: DataFrame) -> DataFrame:
    return found.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(BM25_SQL + _FOUND)
def src_03_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item, from a stored inverted index."""
    index = Postings(spark, folder(spark, "postings")).build(table(spark, sf_dir, "documents"))
    return _told(index.search(_items(spark, sf_dir), 10))


@query(bm25_sql("(SELECT doc_id, text, true AS eligible FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))") + _FOUND)
def str_17_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after upkeep: earlier versions of the labelled documents (their first halves) are replaced, then those
    labelled toxic are forgotten.
    """
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    told = docs.join(labels, "doc_id", "left")
    half = F.when(F.col("toxic").isNull(), F.col("text")).otherwise(F.expr("left(text, cast(length(text) div 2 as int))"))
    index = Postings(spark, folder(spark, "postings")).build(told.withColumn("text", half))
    index.change(told.where("toxic is not null").withColumn("forgotten", F.lit(False)))
    index.change(told.where("toxic = 1").withColumn("forgotten", F.lit(True)))
    return _told(index.search(_items(spark, sf_dir), 10))


_NEAREST = r"""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, e.vec_id, list_cosine_similarity(q.v, e.embedding::DOUBLE[]) AS sim FROM q, {held} e WHERE e.vec_id <> q.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM s)
"""


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(_NEAREST.format(held="embeddings") + "SELECT count(DISTINCT query_id) AS n_queries, count(*) AS wanted, true AS enough FROM r WHERE rank <= 10")
def src_06_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a probe of as many cells as a sample needs for 98 % finds 95 % of the ten nearest of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    index = cells.Cells(spark, folder(spark, "cells")).build(vectors)
    exact = retrieval.neighbours(vectors, _asked(vectors), 10)
    found = index.search(_asked(vectors), 10, probes=index.probes_for(0.98, 10))
    each = cells.recall(found, exact)
    return each.agg(F.count("*").alias("n_queries"), F.sum("wanted").alias("wanted"), (F.sum("hits") >= 0.95 * F.sum("wanted")).alias("enough"))


@query(_NEAREST.format(held="(SELECT * FROM embeddings WHERE label IS NULL OR label % 3 <> 0)") + "SELECT query_id, vec_id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 10")
def str_17_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest after upkeep, over all cells: earlier versions (reversed) of the vectors of every third label from 1 are
    replaced, and those of every third label from 0 forgotten.
    """
    vectors = table(spark, sf_dir, "embeddings")
    early = F.when(F.col("label") % 3 == 1, F.reverse("embedding")).otherwise(F.col("embedding"))
    index = cells.Cells(spark, folder(spark, "cells")).build(vectors.withColumn("embedding", early))
    index.change(vectors.where("label % 3 = 1").withColumn("forgotten", F.lit(False)))
    index.change(vectors.where("label % 3 = 0").withColumn("forgotten", F.lit(True)))
    found = index.search(_asked(vectors), 10)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


_SENTENCES = r"(SELECT item_id * 8 AS item_id, text FROM benchmark UNION ALL SELECT item_id * 8 + unnest(range(1, len(c) + 1)), unnest(c) FROM (SELECT item_id, list_distinct(list_filter(list_slice(list_filter(list_transform(string_split_regex(replace(text, '. ', '? '), '[?;\n]+'), lambda c: trim(regexp_replace(c, '[ \t\n\r\f\v]+', ' ', 'g'))), lambda c: c <> ''), 1, 4), lambda c: c <> trim(regexp_replace(replace(text, '. ', '? '), '[ \t\n\r\f\v]+', ' ', 'g')))) AS c FROM benchmark))"


@query(
    bm25_sql(queries=_SENTENCES)
    + r""", lists AS (SELECT item_id // 8 AS item_id, item_id % 8 AS variant, doc_id, rank FROM ranked WHERE rank <= 256),
fuse AS (SELECT 0 AS s, item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS share FROM lists WHERE variant = 0 AND rank <= 32 UNION ALL
 SELECT 1, item_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM lists WHERE rank <= 96 UNION ALL SELECT 2, item_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM lists),
best AS (SELECT s, item_id, doc_id, row_number() OVER (PARTITION BY s, item_id ORDER BY round(sum(share), 9) DESC, doc_id) AS rank FROM fuse GROUP BY 1, 2, 3 QUALIFY rank <= 12),
more AS (SELECT DISTINCT item_id FROM best b WHERE s = 1 AND NOT EXISTS (SELECT 1 FROM best o WHERE o.s = 0 AND o.item_id = b.item_id AND o.doc_id = b.doc_id)),
last AS (SELECT DISTINCT item_id FROM best b WHERE s = 2 AND item_id IN (FROM more) AND NOT EXISTS (SELECT 1 FROM best o WHERE o.s < 2 AND o.item_id = b.item_id AND o.doc_id = b.doc_id)),
seen AS (SELECT item_id, doc_id, max(s) AS s, arg_max(rank, s) AS rank FROM best WHERE s < 2 OR item_id IN (FROM more) GROUP BY 1, 2),
held AS (SELECT seen.*, length(text) AS size, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS norm FROM seen JOIN documents USING (doc_id) WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
one AS (SELECT *, count(*) OVER (PARTITION BY item_id, norm) - 1 AS others FROM held QUALIFY row_number() OVER (PARTITION BY item_id, norm ORDER BY s DESC, rank) = 1),
placed AS (SELECT *, row_number() OVER w AS place, coalesce(sum(least(size, 2400)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM one WINDOW w AS (PARTITION BY item_id ORDER BY s DESC, rank))
SELECT item_id, doc_id, place, CAST(least(size, 2400, 16000 - before) AS BIGINT) AS chars, others AS n_duplicates,
 CAST(CASE WHEN item_id IN (FROM more) THEN 3 ELSE 2 END AS INTEGER) AS rounds, CASE WHEN item_id IN (FROM last) THEN 'call_budget' ELSE 'no_new_candidates' END AS reason
FROM placed WHERE place <= 12 AND before < 16000"""
)
def ret_07_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fast, then the clauses too (here: sentences), then deeper for those queries only to which that brought something new.

    Searched in a stored inverted index; records that are forgotten since go when texts are read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = Postings(spark, folder(spark, "postings")).build(docs)

    def find(wanted: DataFrame, depth: str) -> DataFrame:
        found = index.search(wanted.select((F.col("query_id") * 8 + F.col("variant")).alias("query_id"), "text"), retrieval.POOLS[depth])
        return found.select(F.expr("query_id div 8").alias("query_id"), (F.col("query_id") % 8).alias("variant"), F.col("doc_id").alias("id"), "rank")

    live = evidence.live(docs, table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.replace("text", F.lit(". "), F.lit("? ")).alias("text"))
    told, last = recall.progressive(asked, find, live)
    long = lambda c: F.col(c).cast("long").alias(c)
    return told.join(last, "query_id").select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), long("place"), long("chars"), F.size("duplicates").cast("long").alias("n_duplicates"), "rounds", "reason")
