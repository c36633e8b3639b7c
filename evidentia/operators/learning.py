"""Lessons: candidates, their evaluations, promotion, and what falls with the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .graph import closure

# The kinds of cases that an evaluation must hold.
KINDS = ("target", "regression", "non_applicable")


def evaluations(cases: DataFrame, by: list[str], fewest: int = 3, most: int = 100) -> DataFrame:
    """(by..., n_cases, passed, valid) of cases (kind, candidate_pass): valid with 3 to 100 cases of all kinds, passed if all do."""
    needed = F.array(*map(F.lit, KINDS))
    each = cases.groupBy(*by).agg(F.count("*").alias("n_cases"), F.bool_and("candidate_pass").alias("passed"), F.collect_set("kind").alias("k"))
    valid = F.col("n_cases").between(fewest, most) & (F.size(F.array_except(needed, F.col("k"))) == 0)
    return each.select(*by, "n_cases", "passed", valid.alias("valid"))


def promoted(candidates: DataFrame, passed: DataFrame) -> DataFrame:
    """candidates (id, family, revision, actor) with `state`: of a family the greatest revision that another than its
    proposer passed (id, actor) is active; lesser passed ones are superseded, and the rest are candidates still.

    Summed up by family before the join, so a family of many revisions costs no task more.
    """
    fit = candidates.alias("c").join(passed.alias("p"), (F.col("c.id") == F.col("p.id")) & (F.col("c.actor") != F.col("p.actor"))).select("c.id", "c.family", "c.revision").distinct()
    best = fit.groupBy("family").agg(F.max("revision").alias("__best"))
    marked = candidates.join(fit.select("id", F.lit(True).alias("__fit")), "id", "left").join(best, "family", "left")
    state = F.when(F.col("__fit").isNull(), "candidate").when(F.col("revision") == F.col("__best"), "active").otherwise("superseded")
    return marked.withColumn("state", state).drop("__fit", "__best")


def invalidated(objects: DataFrame, dependencies: DataFrame, evidence: DataFrame, retired: DataFrame) -> DataFrame:
    """objects (id, state) of which those are invalidated that cite retired records, with all that depends on them.

    dependencies (parent, child), evidence (id, record_id), retired (record_id). Superseded ones keep the fall of others.
    """
    open_ = objects.where(F.col("state").isin("active", "recorded", "candidate")).select("id")
    seeds = evidence.join(retired.select("record_id").distinct(), "record_id", "left_semi").select("id").join(open_, "id", "left_semi")
    fallen = closure(dependencies, seeds).withColumn("__fallen", F.lit(True))
    state = F.when(F.col("__fallen"), "invalidated").otherwise(F.col("state"))
    return objects.join(fallen, "id", "left").withColumn("state", state).drop("__fallen")


def to_promote(candidates: DataFrame, evaluated: DataFrame, blocked: DataFrame) -> DataFrame:
    """(evaluation, candidate) of pending candidates with a recorded evaluation that no audit row has blocked."""
    waiting = candidates.where("state = 'candidate'").select(F.col("id").alias("candidate"))
    return evaluated.join(waiting, "candidate").join(blocked.select("evaluation").distinct(), "evaluation", "left_anti").select("evaluation", "candidate")
