"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source has a target in words: its share by weight, at most `most` times its words, the excess shared anew among the
others. Each of its documents is due target / words copies on average. The whole part is certain; the fractions of a
source are rounded in pairs: one document gives words to the other, which way is drawn so that nobody's expectation
changes, until one of them has no fraction left; the other goes on to the next pair. Every pair keeps the words it had, so
a source misses its target by at most half of the one document that is left over, which is rounded to the nearest. Pairs
are taken from the longest document to the shortest, so that this one is rather short.

Documents of a source are dealt by hash to blocks of about BLOCK, each paired in one chain; what a block has left over
goes to the next level, where BLOCK neighbouring blocks make one, until a source has one. Its last chain is drawn LANDINGS
times, and the draw that misses the target least is taken, for a source of few documents would be off by a part of a
long one otherwise. No task holds more than a block, whatever the size of a source. Equal rows (source, id, size) are one
class from the first shuffle on, so that an id repeated a million times is a row a task; of its copies, each row gets an
equal number or one more.

A null or empty text has size 0 and is taken 0 times 0 words. A null source is a source, the last in order; a null doc_id
is an id. Repeated rows give a row each. The draws depend on the seed and the class alone: reruns agree, however the rows
are dealt. Texts of any length count whole. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: Documents of a source that are paired in one chain, and blocks of one level that make one of the next.
BLOCK = 64
#: Draws of the last chain of a source.
LANDINGS = 32
#: Equal rows that one array lists when a class is written out.
LISTED = 10_000
WORDS = r"[^\x20\x09-\x0D]+"


def ranked(sources: DataFrame, name: str) -> DataFrame:
    """sources (one row each) with `rank`, from 0 by `name` in order of code points, null last.

    Rows are dealt to ranges, however many they are; only the numbers of rows of the ranges are put in one order.
    """
    at = cut(sources.repartitionByRange(F.col(name).asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    before = F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = at.groupBy("range").agg(F.count("*").alias("rows")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col(name).asc_nulls_last()))
    return at.join(counts, "range").withColumn("rank", F.col("before") + inside - 1).drop("range", "before")


def with_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources (words, weight) with `target`: `share` of all words by weight, none over `most` times its words.

    The excess of those at their bound goes to the others by weight, until none is above: a level rises until no more
    sources reach their bound. Only sums come to the driver.
    """
    held, level = -1, 0.0
    total = sources.agg(F.sum("words").alias("words")).first().words or 0
    while total:
        bound = F.col("words") * F.lit(float(most)) <= F.col("weight") * F.lit(level)
        sums = sources.agg(
            F.count(F.when(bound, 1)).alias("n"),
            F.sum(F.when(bound, F.col("words")).otherwise(0)).alias("words"),
            F.sum(F.when(bound, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if sums.n == held or not sums.weight:
            break
        held, level = sums.n, (share * total - most * sums.words) / sums.weight
    return sources.withColumn("target", F.least(F.col("words") * F.lit(float(most)), F.col("weight") * F.lit(level)))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) drawn by hashing."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


_SETTLED = "array<struct<doc_id:bigint,size:bigint,rows:bigint,copies:bigint>>"
_HELD = ["size", "tie", "doc_id", "rows", "sure", "mass"]


def _paired(draw):
    """One pair of a chain: acc.left (the document with a fraction so far) and a new one; who is settled joins acc.done."""

    def step(acc: Column, new: Column) -> Column:
        left = acc["left"]
        up = F.least(left["size"] - left["mass"], new["mass"])
        down = F.least(left["mass"], new["size"] - new["mass"])
        rises = draw(new) * (up + down) < down
        stays = F.when(rises, left["size"] - left["mass"] > new["mass"]).otherwise(left["mass"] > new["size"] - new["mass"])
        extra = (rises != stays).cast("long")
        who = lambda c: F.when(stays, new[c]).otherwise(left[c])
        settled = F.struct(who("doc_id").alias("doc_id"), who("size").alias("size"), who("rows").alias("rows"), (who("sure") + extra).alias("copies"))
        mass = F.greatest(F.lit(0.0), left["mass"] + new["mass"] - extra * who("size"))
        kept = F.struct(*(F.when(stays, left[c]).otherwise(new[c]).alias(c) for c in _HELD[:-1]), mass.alias("mass"))
        return F.struct(kept.alias("left"), F.concat(acc["done"], F.array(settled)).alias("done"))

    return step


def _chained(held: DataFrame, keys: list[str], level: int, seed: int, draws: int) -> DataFrame:
    """held, one row a document with a fraction, as one row a block: who is settled and who is left over."""
    blocks = held.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct(*_HELD)), asc=False).alias("items"))
    start = F.struct(F.get("items", F.lit(0)).alias("left"), F.expr(f"cast(array() as {_SETTLED})").alias("done"))

    def drawn(attempt: Column) -> Column:
        chain = F.aggregate(F.slice("items", 2, F.size("items")), start, _paired(lambda new: uniform(F.lit(seed), F.lit(level), attempt, new["tie"], F.col("rank"))))
        return F.struct(attempt.alias("attempt"), chain.alias("chain"))

    tries = F.transform(F.sequence(F.lit(1), F.lit(draws)), drawn)
    misses = lambda t: F.least(t["chain"]["left"]["mass"], t["chain"]["left"]["size"] - t["chain"]["left"]["mass"])
    nearest = F.array_min(F.transform(tries, lambda t: F.struct(misses(t).alias("miss"), t["attempt"].alias("attempt"), t["chain"].alias("chain"))))["chain"]
    return blocks.select(*keys, "block", nearest.alias("chain")).select(*keys, "block", "chain.left", "chain.done")


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for each row of docs (doc_id, source, text).

    weights: of the sources in order of their names, repeating; share: words of the mix for each word of docs; most: copies
    of a document at most (share may not exceed it).
    """
    if not 0 <= share <= most:
        raise ValueError("the mix cannot be larger than `most` copies of everything")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORDS)).cast("long").alias("size"))
    classes = cut(named.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")))
    sources = ranked(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.count("*").alias("classes")), "source")
    pattern = F.array(*(F.lit(w) for w in weights))
    sources = cut(sources.withColumn("weight", F.get(pattern, (F.col("rank") % len(weights)).cast("int"))))
    sources = cut(with_targets(sources, share, most).withColumn("blocks", F.ceil(F.col("classes") / BLOCK)))

    keys = ["source", "rank", "words", "target"]
    due = F.col("rows") * F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    placed = classes.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("due", due)
    placed = placed.withColumn("tie", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("sure", F.floor("due"))
    mass = (F.col("due") - F.col("sure")) * F.col("size")
    held = placed.select(*keys, F.pmod("tie", "blocks").alias("block"), "size", "tie", "doc_id", "rows", "sure", mass.alias("mass"))

    settled, level, blocks = [], 0, sources.agg(F.max("blocks")).first()[0] or 1
    while True:
        chained = cut(_chained(held, keys, level, seed, LANDINGS if blocks == 1 else 1))
        settled.append(chained.select(*keys, F.explode("done").alias("d")).select(*keys, "d.*"))
        if blocks == 1:
            break
        level, blocks = level + 1, -(-blocks // BLOCK)
        held = chained.select(*keys, F.floor(F.col("block") / BLOCK).alias("block"), "left.*")
    rounded = (F.col("left.mass") * 2 > F.col("left.size")).cast("long")
    every = chained.select(*keys, "left.doc_id", "left.size", "left.rows", (F.col("left.sure") + rounded).alias("copies"))
    for part in settled:
        every = every.union(part)
    listed = every.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {LISTED}"))))
    listed = listed.withColumn("n", F.explode(F.sequence(F.col("part") * LISTED, F.least(F.col("part") * LISTED + LISTED, "rows") - 1)))
    copies = F.expr("copies div rows") + (F.col("n") < F.col("copies") % F.col("rows")).cast("long")
    return listed.select("doc_id", "size", "source", F.col("words").alias("source_size"), F.col("target").cast("double").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))
