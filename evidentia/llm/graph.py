"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


#: A node's edges meet its least neighbour in so many parts.
PARTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with m of their end a; a hub's edges are dealt to PARTS keys, and least, a row for each node, to all of them."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int"))
    return dealt.join(least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["a", "part"]).drop("part")


def _sign(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) of long ids -> (id, component_id): the smallest id reachable, for ids that are not it themselves.

    Null ends and loops are ignored and repeated edges count once; no edges give no rows. Each round hooks a node's
    larger neighbours, then its smaller ones, to the smallest; minima are summed up before the shuffle, so that a hub
    costs one row a task, and the join back deals a hub's edges to several keys.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    was = _sign(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, least).select(F.col("b").alias("x"), "a", "m")
        e = cut(small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        now = _sign(e)
        if now == was:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        was = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
