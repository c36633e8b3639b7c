"""Claims and the records that they cite: status, search results, attachment, beliefs and what repair makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settled

#: Claims of one record that are shown with it, the newest first.
PER_RECORD = 30


def statuses(claims: DataFrame, scope: list[str], order: str) -> DataFrame:
    """claims with `status`: superseded by a later one of the same scope, else active."""
    later = F.lead(order).over(Window.partitionBy(*scope).orderBy(order))
    return claims.withColumn("status", F.when(later.isNotNull(), "superseded").otherwise("active"))


def repaired(claims: DataFrame, deleted: DataFrame, hidden: DataFrame, record: str = "record_id") -> DataFrame:
    """claims whose active ones are retracted where their record was forgotten, and retired where it is hidden.

    History keeps its status: a superseded claim stays one.
    """
    gone = deleted.select(record).distinct().withColumn("__gone", F.lit(True))
    away = hidden.select(record).distinct().withColumn("__away", F.lit(True))
    status = F.when(F.col("status") != "active", F.col("status")).when(F.col("__gone"), "retracted").when(F.col("__away"), "retired").otherwise(F.col("status"))
    return claims.join(gone, record, "left").join(away, record, "left").withColumn("status", status).drop("__gone", "__away")


def shown(status: Column, history: bool = False) -> Column:
    """Whether a claim may be shown: active ones, or with history all that were not retracted."""
    return status != "retracted" if history else status == "active"


def attached(hits: DataFrame, claims: DataFrame, newest: list[Column], limit: int, history: bool = False) -> DataFrame:
    """(query_id, record_id, id, place): the claims of the records found (query_id, record_id, rank), the newest PER_RECORD
    of each record, and of a query the first `limit` by rank.
    """
    kept = claims.where(shown(F.col("status"), history)).withColumn("__n", F.row_number().over(Window.partitionBy("record_id").orderBy(*newest))).where(F.col("__n") <= PER_RECORD)
    both = hits.join(kept.select("record_id", "id", "__n"), "record_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "__n"))
    return both.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "record_id", "id", "place")


def resolved(beliefs: DataFrame, corrections: DataFrame, scope: list[str]) -> DataFrame:
    """beliefs (id, state, scope...) of which corrections (id, supersedes) name some: these are superseded if both are of
    one scope and the correcting belief is current itself; the others keep their state.
    """
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in scope]
    named = corrections.where("id != supersedes").alias("c")
    named = named.join(beliefs.alias("a"), F.col("c.id") == F.col("a.id")).where("a.state = 'recorded'").join(beliefs.alias("b"), F.col("c.supersedes") == F.col("b.id"))
    for s in same:
        named = named.where(s)
    gone = named.select(F.col("b.id").alias("id")).distinct().withColumn("__gone", F.lit(True))
    state = F.when(F.col("__gone"), "superseded").otherwise(F.col("state"))
    return beliefs.join(gone, "id", "left").withColumn("state", state).drop("__gone")


def gated(beliefs: DataFrame, coverage: DataFrame, domain: str) -> DataFrame:
    """beliefs with `accepted`: one that speaks of none or all needs its domain covered (domain, covered); a value does not."""
    covered = coverage.select(domain, F.col("covered").alias("__ok"))
    accepted = (F.col("quantifier") == "value") | (F.col("quantifier").isin("none", "all") & F.coalesce("__ok", F.lit(False)))
    return beliefs.join(covered, domain, "left").withColumn("accepted", accepted).drop("__ok")


def bridged(seeds: DataFrame, links: DataFrame, identities: DataFrame, most: int = 16, owners: int = 2, degree: int = 6) -> DataFrame:
    """(query_id, from_record, id, via): what a seed's (query_id, record, at) owners have to do with, by confirmed identities.

    links (record, entity, at) and identities (account, person, valid_from, valid_to). A seed's first `degree` entities
    that a person owned at the seed's time lead to that person (`owners` of each at most, by name), and from there to the
    person's records, linked directly or by an account owned at the record's own time; of these the first `most` by id.
    """
    from ..functions.rules import valid_at

    own = links.join(seeds.select("record").distinct(), "record", "left_semi").select("record", "entity").distinct().withColumn("__d", F.row_number().over(Window.partitionBy("record").orderBy("entity"))).where(F.col("__d") <= degree)
    owned = seeds.join(own, "record").alias("s").join(identities.alias("i"), F.col("s.entity") == F.col("i.account")).where(F.coalesce(F.col("i.valid_from") <= F.col("s.at"), F.col("i.valid_from").isNull()) & F.coalesce(F.col("s.at") < F.col("i.valid_to"), F.col("i.valid_to").isNull()))
    owned = owned.select("s.query_id", "s.record", "s.entity", "i.person").distinct()
    owned = owned.withColumn("__o", F.row_number().over(Window.partitionBy("query_id", "record", "entity").orderBy("person"))).where(F.col("__o") <= owners).select("query_id", "record", "person").distinct()
    # Only what the seeds' persons have to do with is looked for.
    owned = settled(owned)
    persons = owned.select("person").distinct()
    theirs = identities.join(persons, "person", "left_semi")
    held = links.alias("l").join(theirs.alias("i"), F.col("l.entity") == F.col("i.account")).where(valid_at(F.col("i.valid_from"), F.col("i.valid_to"), F.col("l.at")))
    related = held.select("i.person", "l.record").union(links.select(F.col("entity").alias("person"), "record").join(persons, "person", "left_semi")).distinct()
    first = related.withColumn("__n", F.row_number().over(Window.partitionBy("person").orderBy("record"))).where(F.col("__n") <= most + 1).select("person", F.col("record").alias("id"), "__n")
    return owned.join(first, "person").where((F.col("id") != F.col("record")) & (F.col("__n") <= most)).select("query_id", F.col("record").alias("from_record"), "id", F.col("person").alias("via"))
