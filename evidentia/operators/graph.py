"""Graph walks: closure of lineage, bounded hops and personalised diffusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import valid_at
from ..session import settled

DAMPING, RECORD_DEGREE, ENTITY_DEGREE, FLOOR = 0.6, 6, 16, 1e-9


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id): the roots and all that edges (parent, child) reach from them, however far; cycles end, as each id is met once."""
    seen = settled(roots.select("id").distinct())
    frontier = seen
    while not frontier.isEmpty():
        found = edges.join(frontier, edges["parent"] == frontier["id"]).select(F.col("child").alias("id")).distinct()
        frontier = settled(found.join(seen, "id", "left_anti"))
        seen = seen.union(frontier)
    return seen


def hops(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(seed, id, hop): undirected neighbours of each seed within `most` hops (1 to 3), with the least hop."""
    if not 1 <= most <= 3:
        raise ValueError("hops must be from 1 to 3")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    layer = seeds.select(F.col("id").alias("seed"), F.col("id").alias("at")).distinct()
    out = layer.withColumn("hop", F.lit(0))
    for h in range(1, most + 1):
        layer = layer.join(both, F.col("at") == F.col("a")).select("seed", F.col("b").alias("at")).distinct()
        out = out.union(layer.withColumn("hop", F.lit(h)))
    return out.groupBy("seed", F.col("at").alias("id")).agg(F.min("hop").alias("hop"))


def related(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, other): the other ends of the edges (a, b) that have a seed (id) at either end, each once."""
    ahead = seeds.join(edges, F.col("id") == F.col("a")).select("id", F.col("b").alias("other"))
    return ahead.union(seeds.join(edges, F.col("id") == F.col("b")).select("id", "a")).distinct()


def typed_hops(edges: DataFrame, seeds: DataFrame, most: int, at, max_edges: int = 200) -> DataFrame:
    """(seed, edge, hop, truncated): the relations (edge, a, b, valid_from, valid_to) that are valid at `at` and lie within
    `most` hops of each seed, met from either end; of a seed the first max_edges by hop and id, truncated telling of more.
    """
    if not (1 <= most <= 3 and 1 <= max_edges <= 200):
        raise ValueError("hops must be from 1 to 3 and edges from 1 to 200")
    valid = edges.where(valid_at(F.col("valid_from"), F.col("valid_to"), at)).select("edge", "a", "b")
    ends = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    both = valid.select("edge", F.col("edge").isNull().alias("__unknown"), F.inline(F.array(ends("a", "b"), ends("b", "a")))).where("a is not null")
    # An entity's first max_edges + 1 relations are enough: a seed that met n of them before wants max_edges + 1 - n more at
    # most. A seed that has more than max_edges goes no further, and one that goes on has met every relation of its entities.
    place = F.dense_rank().over(Window.partitionBy("a").orderBy("__unknown", "edge"))
    near = both.withColumn("__n", place).where(F.col("__n") <= max_edges + 1)
    near = near.withColumn("__e", F.struct("__unknown", "edge")).groupBy("a").agg(F.sort_array(F.collect_set("__e")).alias("edges"), F.collect_set("b").alias("ends"))
    near = settled(near.withColumn("edges", F.col("edges.edge")))
    kind = f"array<struct<edge:{valid.schema['edge'].dataType.simpleString()},hop:int>>"
    reached = seeds.select(F.col("id").alias("seed")).where("id is not null").distinct().select("seed", F.array("seed").alias("ends"), F.array().cast(kind).alias("kept"))
    for hop in range(1, most + 1):
        layer = reached.where(F.size("kept") <= max_edges).select("seed", F.explode("ends").alias("a"))
        every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
        further = every("ends") if hop < most else F.lit(None)
        met = layer.join(near, "a").groupBy("seed").agg(F.sort_array(every("edges")).alias("met"), further.alias("__ends"))
        met = met.withColumn("met", F.concat(F.array_compact("met"), F.filter("met", lambda e: e.isNull())))  # an unknown one is last
        new = F.slice(F.array_except(F.coalesce("met", F.array().cast(met.schema["met"].dataType)), "kept.edge"), F.lit(1), max_edges + 1 - F.size("kept"))
        told = F.concat("kept", F.transform(new, lambda e: F.struct(e.alias("edge"), F.lit(hop).alias("hop"))))
        reached = reached.join(met, "seed", "left").select("seed", F.col("__ends").alias("ends"), told.alias("kept"))
        reached = settled(reached) if hop < most else reached
    first = reached.select("seed", F.explode(F.slice("kept", 1, max_edges)).alias("e"), (F.size("kept") > max_edges).alias("truncated"))
    return first.select("seed", "e.edge", "e.hop", "truncated")


def _capped(links: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return links.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def expanded(links: DataFrame, records: DataFrame | None = None, record_degree: int = RECORD_DEGREE, entity_degree: int = ENTITY_DEGREE) -> DataFrame:
    """(record, met): one step over links (record, entity) from the records, all where none are named, with both degrees capped."""
    links = links.select("record", "entity").where("record is not null and entity is not null").distinct()
    named = links if records is None else links.join(records, "record", "left_semi")
    outward = _capped(named, "record", [F.col("entity")], record_degree)
    near = links
    if records is not None:
        # Only what is walked over is ranked: both caps are by the very key that the walk comes from.
        outward = settled(outward)
        near = links.join(outward.select("entity").distinct(), "entity", "left_semi")
    inward = _capped(near, "entity", [F.desc("record")], entity_degree).groupBy("entity").agg(F.collect_list("record").alias("met"))
    # What an entity leads to moves as one list, entity_degree long at most; a record gathers record_degree of them.
    met = outward.join(inward, "entity").groupBy("record").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"))
    return met.select("record", F.explode("met").alias("met")).where("record != met")


def diffusion(links: DataFrame, seeds: DataFrame, rounds: int = 2, damping: float = DAMPING, record_degree: int = RECORD_DEGREE, entity_degree: int = ENTITY_DEGREE) -> DataFrame:
    """(query_id, record, score) of records that personalised diffusion reaches from seeds (query_id, record, weight), the
    seeds left out.

    links (record, entity) is capped to a record's least entities and an entity's newest (greatest) records. Each round
    a record gives its mass in equal shares to its entities, these theirs to the records met, and (1 - damping) of the
    seeds' share comes back. The walk stays within `rounds` hops of the seeds, so only their neighbourhood is ranked and
    joined, and every query walks apart from the others.
    """

    def outward(of: DataFrame) -> DataFrame:
        return _capped(links.join(of.select("record").distinct(), "record", "left_semi"), "record", [F.col("entity")], record_degree)

    def inward(of: DataFrame) -> DataFrame:
        return _capped(links.join(of.select("entity").distinct(), "entity", "left_semi"), "entity", [F.desc("record")], entity_degree)

    given = seeds.groupBy("query_id", "record").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("weight"))
    total = given.groupBy("query_id").agg(F.sum("weight").alias("total"))
    start = settled(given.join(total, "query_id").select("query_id", "record", (F.col("weight") / F.col("total")).alias("p")))
    visited = start.select("query_id", "record")
    for _ in range(rounds):
        met = settled(visited.join(outward(visited), "record").select("query_id", "entity").distinct())
        visited = settled(visited.union(met.join(inward(met), "entity").select("query_id", "record")).distinct())
    share = lambda by: F.count("*").over(Window.partitionBy("query_id", by))
    own = settled(visited.join(outward(visited), "record").withColumn("n", share("record")))
    back = visited.join(inward(own), "record").join(own.select("query_id", "entity").distinct(), ["query_id", "entity"], "left_semi")
    back = settled(back.withColumn("n", share("entity")))
    mass = start.select("query_id", "record", F.col("p").alias("mass"))
    for _ in range(rounds):
        entity = mass.join(own, ["query_id", "record"]).groupBy("query_id", "entity").agg(F.sum(F.col("mass") / F.col("n")).alias("mass"))
        record = entity.join(back, ["query_id", "entity"]).groupBy("query_id", "record").agg(F.sum(F.col("mass") / F.col("n")).alias("got"))
        held = visited.join(record, ["query_id", "record"], "left").join(start, ["query_id", "record"], "left")
        mass = held.select("query_id", "record", ((1 - damping) * F.coalesce("p", F.lit(0.0)) + damping * F.coalesce("got", F.lit(0.0))).alias("mass"))
    return mass.join(start, ["query_id", "record"], "left_anti").where(F.col("mass") > FLOOR).select("query_id", "record", F.col("mass").alias("score"))
