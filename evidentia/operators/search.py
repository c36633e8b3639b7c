"""Hybrid search: keyword and vector channels over a query's variants, graph leads, filters, recency and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules, text as tx
from . import graph, retrieval

# The seeds of a walk, the weight of its channel, and the most variants of a query.
GRAPH_SEEDS, GRAPH_WEIGHT, VARIANTS = 6, 0.3, 8


def channels(records: DataFrame, queries: DataFrame, vectors: DataFrame | None, asked: DataFrame | None, depth: str) -> DataFrame:
    """(query_id, id, channel, rank, similarity): the raw lists of both channels, for each variant of a query."""
    pool = retrieval.POOLS[depth]
    few = F.when(F.col("variant").between(0, VARIANTS - 1), F.col("variant")).otherwise(F.raise_error(F.lit(f"variants are numbered from 0 to {VARIANTS - 1}")))
    texts = queries.select((F.col("query_id") * VARIANTS + few).alias("query_id"), "text")
    words = retrieval.bm25(records, texts, pool, "id", "text").select("query_id", F.col("doc_id").alias("id"), "rank", F.lit(None).cast("double").alias("similarity"))
    split = lambda df, name: df.select(F.expr(f"query_id div {VARIANTS}").alias("query_id"), "id", F.concat(F.lit(f"{name}/"), F.col("query_id") % VARIANTS).alias("channel"), "rank", "similarity")
    out = split(words, "words")
    if vectors is not None:
        near = retrieval.neighbours(vectors, asked.select((F.col("query_id") * VARIANTS).alias("query_id"), "vector"), pool, "id", "vector", same=True)
        out = out.unionByName(split(near.select("query_id", "id", "rank", "similarity"), "vectors"))
    return out


def hybrid(
    records: DataFrame,
    queries: DataFrame,
    now: Column,
    vectors: DataFrame | None = None,
    asked: DataFrame | None = None,
    allowed: DataFrame | None = None,
    excluded: DataFrame | None = None,
    hidden: DataFrame | None = None,
    links: DataFrame | None = None,
    depth: str = "fast",
    limit: int = 8,
) -> DataFrame:
    """(query_id, id, score, similarity, rank): the first `limit` records of each query.

    records (id, text, at): what may be found, forgotten ones left out; queries (query_id, variant, text), variant 0 being
    the query itself; vectors (id, vector) with asked (query_id, vector). allowed (id) and excluded (query_id, id) take
    rows off the raw lists, whose ranks keep their gaps. links (record, entity) add leads that diffusion finds from the
    best GRAPH_SEEDS, but for depth fast. Texts are read again at the end, for the records in question only: hidden (id)
    ones go, recency weighs in, and the gate wants a content term of a variant or a similarity.
    """
    pool = channels(records.select("id", "text"), queries, vectors, asked, depth)
    if allowed is not None:
        pool = pool.join(allowed.select("id").distinct(), "id", "left_semi")
    if excluded is not None:
        pool = pool.join(excluded.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    fused = retrieval.fused(pool).join(pool.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity")), ["query_id", "id"])
    fused = fused.select("query_id", "id", "score", "similarity")
    if links is not None and depth != "fast":
        seeds = retrieval.top(fused, "query_id", F.round("score", 9), "id", GRAPH_SEEDS).select("query_id", F.col("id").alias("record"), F.col("score").alias("weight"))
        leads = graph.diffusion(links, seeds).select("query_id", F.col("record").alias("id"), F.col("score").alias("mass"))
        if allowed is not None:
            leads = leads.join(allowed.select("id").distinct(), "id", "left_semi")
        ranked = retrieval.top(leads, "query_id", F.round("mass", 9), "id", retrieval.POOLS["deep"])
        if excluded is not None:
            ranked = ranked.join(excluded.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
        more = ranked.select("query_id", "id", (F.lit(GRAPH_WEIGHT) / (retrieval.RRF_BASE + F.col("rank"))).alias("score"), F.lit(None).cast("double").alias("similarity"))
        fused = fused.unionByName(more).groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.max("similarity").alias("similarity"))
    live = records if hidden is None else records.join(hidden.select("id").distinct(), "id", "left_anti")
    held = live.join(fused.select("id").distinct(), "id", "left_semi").select("id", tx.content_terms("text").alias("dt"), "at").join(fused, "id")
    terms = queries.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(tx.content_terms("text")))).alias("qt"))
    fit = rules.accepted(F.size(F.array_intersect("qt", "dt")), F.col("similarity"))
    final = held.join(terms, "query_id").where(fit).select("query_id", "id", rules.recency(F.col("score"), F.col("at"), now).alias("score"), "similarity")
    return retrieval.top(final, "query_id", F.round("score", 9), "id", limit)
