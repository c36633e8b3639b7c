"""Recall over stages and branches, and the rules of queues around it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..session import settled
from . import retrieval


def intent(document: Column, main: Column, variant: Column) -> tuple[Column, Column]:
    """Whether a document shares a term with the main query, and two (or all) with a variant."""
    shared = F.size(F.array_intersect(document, variant))
    return F.size(F.array_intersect(document, main)) > 0, (F.size(variant) > 0) & (shared >= F.least(F.lit(2), F.size(variant)))


def claimable(state: Column, until: Column, now: Column) -> Column:
    """Whether a batch may be claimed: pending, a due retry, or a lease that ran out."""
    return (state == "pending") | (state.isin("retry_wait", "leased") & F.coalesce(until <= now, F.lit(False)))


def group_key(source: Column, conversation: Column, stream: Column, item: Column) -> Column:
    """An event's group: source and conversation, or source, stream and item where it has none."""
    return F.concat_ws(":", source, F.coalesce(conversation, F.concat_ws(":", stream, item)))


def obligations(signals: DataFrame, models: DataFrame, done: DataFrame, block: int = 256) -> DataFrame:
    """(doc_id, model) that a signal (doc_id) of a record asks of every model, but for what is done (doc_id, model).

    The names of the models, a stated set, go to the rows in blocks of arrays, so signals fan out by explode; there are as
    many rows as obligations, which is what is asked for.
    """
    named, due = [r.model for r in models.select("model").distinct().orderBy("model").toLocalIterator()], None
    for i in range(0, len(named), block):
        part = signals.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, named[i : i + block]))).alias("model"))
        due = part if due is None else due.union(part)
    if due is None:
        return done.select("doc_id", "model").limit(0)
    return due.join(done.select("doc_id", "model"), ["doc_id", "model"], "left_anti").select("doc_id", "model")


def status(found: Column, failed: Column) -> Column:
    """candidates_found, retrieval_incomplete or no_relevant_evidence."""
    return F.when(found > 0, "candidates_found").when(failed, "retrieval_incomplete").otherwise("no_relevant_evidence")


def adaptive(pool: DataFrame, text_key: str, wanted: int, stages: tuple[int, ...] = (32, 96, 256)) -> DataFrame:
    """(query_id, rounds, n_found, reason) of a ranked pool, searched in widening stages.

    A stage brings the ranks up to its bound; of equal texts the best rank counts. A query ends with the first stage
    after which it has `wanted` texts, with a later one that adds none, or with the last.
    """
    first = pool.groupBy("query_id", text_key).agg(F.min("rank").alias("rank"))
    stage = sum((F.when(F.col("rank") > bound, 1).otherwise(0) for bound in stages[:-1]), F.lit(0))
    counts = first.where(F.col("rank") <= stages[-1]).groupBy("query_id").agg(*(F.count(F.when(stage == s, 1)).alias(f"n{s}") for s in range(len(stages))))
    total, rounds, found = F.lit(0).cast("long"), F.lit(len(stages)), None
    sums = []
    for s in range(len(stages)):
        total = total + F.col(f"n{s}")
        sums.append(total)
    found = sums[-1]
    for s in range(len(stages) - 2, -1, -1):
        ends = (sums[s] >= wanted) | (F.lit(s > 0) & (F.col(f"n{s}") == 0))
        rounds, found = F.when(ends, s + 1).otherwise(rounds), F.when(ends, sums[s]).otherwise(found)
    reason = F.when(found >= wanted, "enough").when(rounds < len(stages), "nothing_new").otherwise("last_stage")
    return counts.select("query_id", rounds.alias("rounds"), found.alias("n_found"), reason.alias("reason"))


def asked(queries: DataFrame, clauses: bool) -> DataFrame:
    """(query_id, variant, text): each query (query_id, text) as variant 0 and, if asked for, its different clauses after it."""
    parts = F.array_distinct(F.filter(tx.clauses("text"), lambda c: c != tx.squeezed("text"))) if clauses else F.array().cast("array<string>")
    return queries.select("query_id", F.posexplode(F.concat(F.array("text"), F.coalesce(parts, F.array().cast("array<string>")))).alias("variant", "text"))


def fused_lists(lists: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, rank): the first `limit` of each query by reciprocal rank fusion of its variants' lists (query_id, variant, id, rank)."""
    found = retrieval.fused(lists.withColumn("channel", F.col("variant").cast("string")))
    return retrieval.top(found, "query_id", F.round("score", 9), "id", limit).select("query_id", "id", "rank")


def progressive(
    queries: DataFrame,
    find: Callable[[DataFrame, str], DataFrame],
    records: DataFrame,
    limit: int = 12,
    budget: int = 16_000,
    stages: tuple[str, ...] = ("fast", "balanced", "deep"),
    shown: int = 2400,
) -> tuple[DataFrame, DataFrame]:
    """Recall in widening stages, of which each searches only for the queries that are not done.

    queries (query_id, text), a stated set of one row an id; find(asked (query_id, variant, text), stage) gives lists
    (query_id, variant, id, rank); records (id, text), one row an id, are those that may be told now. The first stage asks the queries
    themselves, the later ones their clauses too. A query is done after a later stage that adds no record
    (no_new_candidates) or the last (call_budget). Records that a later stage found lead; what only earlier ones found
    follows. Texts are read at the end, for the records found only: of equal texts (but for white space) the first stays
    and names the others, empty and null ones are left out, and `limit` texts of `shown` characters each are told while
    the text budget lasts; the last is cut where it ends.

    Gives (query_id, id, place, chars, duplicates) and, for every query, (query_id, rounds, reason).
    """
    going, pool = settled(queries.select("query_id", "text")), None
    trace = going.select("query_id", F.lit(0).alias("stage"), F.lit(True).alias("added"))
    for stage, depth in enumerate(stages):
        if stage and going.isEmpty():
            break
        found = settled(fused_lists(find(asked(going, stage > 0), depth), limit).withColumn("stage", F.lit(stage)))
        if pool is None:
            pool = found
            continue
        new = found.join(pool.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti").select("query_id").distinct().withColumn("added", F.lit(True))
        told = settled(going.join(new, "query_id", "left").select("query_id", "text", F.coalesce("added", F.lit(False)).alias("added")))
        trace = trace.unionByName(told.select("query_id", F.lit(stage).alias("stage"), "added"))
        pool, going = pool.unionByName(found), told.where("added").drop("added")
    last = trace.groupBy("query_id").agg((F.max("stage") + 1).alias("rounds"), F.max_by("added", "stage").alias("added"))
    last = last.select("query_id", "rounds", F.when(F.col("added"), "call_budget").otherwise("no_new_candidates").alias("reason"))
    seen = pool.groupBy("query_id", "id").agg(F.min(F.struct((-F.col("stage")).alias("late"), "rank")).alias("at"))
    held = records.select("id", "text").join(seen.select("id").distinct(), "id", "left_semi").where(F.length("text") > 0)
    held = held.select("id", F.length("text").alias("size"), F.sha2(tx.squeezed("text").cast("binary"), 256).alias("norm")).join(seen, "id")
    same = held.groupBy("query_id", "norm").agg(F.sort_array(F.collect_list(F.struct("at", "id", "size"))).alias("all"))
    first = same.select("query_id", F.col("all")[0].alias("one"), F.transform(F.slice("all", 2, F.size("all")), lambda r: r["id"]).alias("duplicates"))
    order = Window.partitionBy("query_id").orderBy("one.at", "one.id")
    size = F.least("one.size", F.lit(shown))
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = first.select("query_id", F.col("one.id").alias("id"), F.row_number().over(order).alias("place"), size.alias("size"), before.alias("before"), "duplicates")
    kept = placed.where((F.col("place") <= limit) & (F.col("before") < budget))
    return kept.select("query_id", "id", "place", F.least("size", budget - F.col("before")).alias("chars"), "duplicates"), last


def branches(hits: DataFrame, accepted: Column, limit: int, wide: int) -> DataFrame:
    """Round-robin merge of each query's branches (query_id, branch, id, rank): which branches found an id, in which round and
    by which it first comes, and its place; `limit` of a branch, `wide` in all.
    """
    turn = F.row_number().over(Window.partitionBy("query_id", "branch").orderBy("rank", "id"))
    dealt = hits.where(accepted).withColumn("round", turn).where(F.col("round") <= limit)
    merged = dealt.groupBy("query_id", "id").agg(F.min(F.struct("round", "branch")).alias("at"), F.sort_array(F.collect_set("branch")).alias("branches"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id"))
    return merged.withColumn("place", place).where(F.col("place") <= wide).select("query_id", "id", "at.round", "at.branch", "branches", "place")


def shared_searches(branches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a query's branches (query_id, branch, text) have to search for: (query_id, search, text), each different text of a
    query once, and (query_id, branch, search), which search answers a branch.
    """
    first = branches.groupBy("query_id", "text").agg(F.min("branch").alias("search"))
    return first.select("query_id", "search", "text"), branches.join(first, ["query_id", "text"]).select("query_id", "branch", "search")
