"""Queries of lessons, repair after retirement, coverage, epochs and due work.

Orders stand for candidates (their customer is the family, their clerk the actor), line items for cases and evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx
from ..operators import claims as cl, evidence, learning
from ..session import table
from .registry import query

_CASES = "(SELECT l_orderkey AS id, ['target', 'regression', 'non_applicable'][1 + l_partkey % 3] AS kind, l_quantity > 5 AS ok FROM lineitem)"
_EVALUATED = f"(SELECT id, count(*) AS n_cases, bool_and(ok) AS passed, count(*) BETWEEN 3 AND 100 AND count(DISTINCT kind) = 3 AS valid FROM {_CASES} GROUP BY id)"


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, learning.KINDS)), (F.col("l_partkey") % 3).cast("int"))
    cases = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), kind.alias("kind"), (F.col("l_quantity") > 5).alias("candidate_pass"))
    return learning.evaluations(cases, ["id"])


@query(f"SELECT * FROM {_EVALUATED}")
def knw_14_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir)


_CANDIDATES = "(SELECT o_orderkey AS id, o_custkey AS family, o_orderkey AS revision, o_orderpriority AS actor FROM orders)"
_PROMOTED = f"""(SELECT c.id, c.family, CASE WHEN f.id IS NULL THEN 'candidate' WHEN c.revision = max(CASE WHEN f.id IS NOT NULL THEN c.revision END) OVER (PARTITION BY c.family) THEN 'active' ELSE 'superseded' END AS state
 FROM {_CANDIDATES} c LEFT JOIN (SELECT e.id FROM {_EVALUATED} e JOIN {_CANDIDATES} o USING (id) WHERE passed AND valid AND actor <> '1-URGENT') f USING (id))"""


def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, family, state): every evaluation is by an urgent order's actor, who cannot pass its own."""
    candidates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("revision"), F.col("o_orderpriority").alias("actor"))
    passed = evaluated(spark, sf_dir).where("passed and valid").select("id", F.lit("1-URGENT").alias("actor"))
    return learning.promoted(candidates, passed).select("id", "family", "state")


@query(f"SELECT id, family, state FROM {_PROMOTED}")
def knw_14_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One active lesson a family: the greatest revision that another than its proposer passed."""
    return promoted(spark, sf_dir)


@query(f"SELECT p.id AS procedure, l.l_suppkey AS tool FROM {_PROMOTED} p JOIN lineitem l ON l.l_orderkey = CAST(json_extract('{{\"candidate\": ' || p.id || '}}', '$.candidate') AS BIGINT) WHERE p.state = 'active' AND l.l_linenumber = 1")
def knw_12_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures whose lesson is active, by the id that their JSON holds."""
    payload = F.to_json(F.struct(F.col("l_orderkey").alias("candidate")))
    procedures = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.get_json_object(payload, "$.candidate").cast("long").alias("id"), F.col("l_suppkey").alias("tool"))
    active = promoted(spark, sf_dir).where("state = 'active'").select("id")
    return procedures.join(active, "id").select(F.col("id").alias("procedure"), "tool")


@query(f"SELECT e.id AS evaluation, e.id AS candidate FROM {_EVALUATED} e JOIN {_PROMOTED} p USING (id) WHERE p.state = 'candidate' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = e.id AND b.o_orderstatus = 'F')")
def join_16_to_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations of pending candidates that no audit row blocks."""
    done = evaluated(spark, sf_dir).select(F.col("id").alias("evaluation"), F.col("id").alias("candidate"))
    blocked = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("evaluation"))
    return learning.to_promote(promoted(spark, sf_dir), done, blocked)


_FALLEN = """WITH RECURSIVE seed AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey IN (SELECT doc_id FROM labels WHERE toxic = 1)),
f(id) AS (SELECT id FROM seed UNION SELECT o.o_orderkey FROM orders o JOIN f ON o.o_orderkey // 3 = f.id AND o.o_orderkey >= 3)"""


@query(_FALLEN + " SELECT o_orderkey AS id, CASE WHEN f.id IS NOT NULL THEN 'invalidated' ELSE 'recorded' END AS state FROM orders LEFT JOIN f ON f.id = o_orderkey")
def rec_02_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cites forgotten evidence falls, with all that depends on it, however far."""
    orders = table(spark, sf_dir, "orders")
    objects = orders.select(F.col("o_orderkey").alias("id"), F.lit("recorded").alias("state"))
    dependencies = orders.where("o_orderkey >= 3").select(F.expr("o_orderkey div 3").alias("parent"), F.col("o_orderkey").alias("child"))
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("record_id"))
    retired = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("record_id"))
    return learning.invalidated(objects, dependencies, cited, retired)


@query(
    """
WITH dead AS (SELECT doc_id FROM labels WHERE toxic = 1), away AS (SELECT doc_id FROM labels WHERE quality = 0)
SELECT 'claim' AS kind, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'superseded' WHEN user_id IN (SELECT doc_id FROM dead) THEN 'retracted' WHEN user_id IN (SELECT doc_id FROM away) THEN 'retired' ELSE 'active' END AS state FROM events
UNION ALL SELECT 'identity', vec_id, CASE WHEN vec_id IN (SELECT doc_id FROM dead UNION SELECT doc_id FROM away) THEN 'revoked' ELSE 'confirmed' END FROM embeddings
UNION ALL SELECT 'curated', o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderkey IN (SELECT doc_id FROM dead UNION SELECT doc_id FROM away)) > 0 THEN 'retired' ELSE 'live' END FROM orders GROUP BY o_custkey"""
)
def lif_04_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forgotten and hidden records leave of claims, identities and curated entries, told anew from the logs."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "record_id")
    dead, away = labels.where("toxic = 1"), labels.where("quality = 0")
    retired = dead.select("record_id").union(away.select("record_id")).distinct()
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("record_id"), F.when(F.col("event_id") % 3 == 0, "superseded").otherwise("active").alias("status"))
    out = cl.repaired(rows, dead, away).select(F.lit("claim").alias("kind"), "id", F.col("status").alias("state"))
    gone = retired.withColumn("gone", F.lit(True))
    edges = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id")).join(gone, "record_id", "left")
    out = out.union(edges.select(F.lit("identity"), "record_id", F.when(F.col("gone"), "revoked").otherwise("confirmed")))
    entries = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("record_id")).join(gone, "record_id", "left")
    fallen = entries.groupBy("o_custkey").agg(F.bool_or(F.coalesce("gone", F.lit(False))).alias("fallen"))
    return out.union(fallen.select(F.lit("curated"), "o_custkey", F.when(F.col("fallen"), "retired").otherwise("live")))


@query("SELECT event_id, user_id, 1 + (event_id > (SELECT max(event_id) // 2 FROM events))::INT AS epoch, event_id > (SELECT max(event_id) // 2 FROM events) AS valid FROM events")
def lif_06_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset half way begins an epoch: what was written before counts no more."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    reset = F.lit((events.agg(F.max("event_id")).first()[0] or 0) // 2)
    return evidence.in_epochs(events, "event_id", [reset]).select("event_id", "user_id", "epoch", "valid")


@query(
    """
WITH a AS (SELECT user_id AS source, event_id, ['unknown', 'partial', 'complete', 'failed'][1 + event_id % 4] AS state, CASE WHEN event_id % 3 > 0 THEN ts END AS through_at, CASE WHEN event_id % 5 > 0 THEN event_type END AS note FROM events),
v AS (SELECT * FROM a WHERE state <> 'complete' OR (through_at IS NOT NULL AND note IS NOT NULL))
SELECT source, state, through_at FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY event_id DESC) = 1"""
)
def lif_07_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last valid assertion of each source; a complete one must say until when, and of what."""
    state = F.get(F.array(*map(F.lit, ("unknown", "partial", "complete", "failed"))), (F.col("event_id") % 4).cast("int"))
    said = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), "event_id", state.alias("state"), F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("through_at"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("note"))
    return evidence.coverage(said, "source", "event_id").select("source", "state", "through_at")


@query(
    """
WITH t AS (SELECT o_orderkey AS id, o_custkey, CAST(o_orderkey % 4 AS INTEGER) AS version, o_orderdate AS due_at FROM orders WHERE o_orderstatus = 'O'),
e AS (SELECT l_orderkey AS id, CAST(l_linenumber % 4 AS INTEGER) AS version, l_partkey, l_linenumber FROM lineitem WHERE l_quantity > 25)
SELECT e.id, e.version, e.l_partkey, e.l_linenumber FROM e JOIN t USING (id, version)"""
)
def join_14_event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of tasks as they are now: those of another version of the task are void."""
    tasks = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).cast("int").alias("version"))
    told = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 4).cast("int").alias("version"), "l_partkey", "l_linenumber")
    return told.join(tasks, ["id", "version"]).select("id", "version", "l_partkey", "l_linenumber")


@query(
    """
SELECT o_orderkey, o_orderdate AS due_at FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber % 4 = o.o_orderkey % 4 AND l.l_quantity > 25)
ORDER BY o_orderdate, o_orderkey LIMIT 50"""
)
def srt_10_earliest_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reminders that are due first, but for those whose event of this version is told: fifty at a time."""
    told = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") % 4).cast("long").alias("version"))
    due = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").withColumn("version", F.col("o_orderkey") % 4).join(told, ["o_orderkey", "version"], "left_anti")
    return due.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", F.col("o_orderdate").alias("due_at"))


@query("SELECT vec_id AS id FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = vec_id AND lang = 'en')")
def set_06_current_less_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")).join(new, "id", "left_anti")


@query(
    """
WITH p AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 2 = 0 THEN 'phone' ELSE 'email' END AS namespace,
 CASE WHEN o_orderkey % 2 = 0 THEN '+44 (7' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || ') ' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') ELSE 'C' || o_custkey || '@' || CASE WHEN o_orderkey % 3 = 0 THEN 'Mail.Example.ORG' ELSE 'mail.example.org' END END AS address FROM orders),
n AS (SELECT record_id, namespace, CASE namespace WHEN 'phone' THEN replace(replace(replace(address, ' ', ''), '(', ''), ')', '') ELSE split_part(address, '@', 1) || '@' || lower(split_part(address, '@', 2)) END AS address FROM p)
SELECT namespace, address, count(DISTINCT record_id) AS n_records FROM n GROUP BY 1, 2"""
)
def knw_13_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of the participants of records: one for each address in normal form, however it was written."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    number = F.concat(F.lit("+44 (7"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit(") "), F.lpad(customer, 6, "0"))
    mail = F.concat(F.lit("C"), customer, F.lit("@"), F.when(key % 3 == 0, "Mail.Example.ORG").otherwise("mail.example.org"))
    people = F.array(F.struct(F.when(key % 2 == 0, "phone").otherwise("email").alias("namespace"), F.when(key % 2 == 0, number).otherwise(mail).alias("address")))
    rows = table(spark, sf_dir, "orders").select(key.alias("record_id"), people.alias("participants"))
    return evidence.accounts(rows, "record_id").groupBy("namespace", "address").agg(F.count_distinct("record_id").alias("n_records"))


@query("SELECT doc_id, '{\"chars\":' || n_chars || ',\"lang\":\"' || lang || '\",\"tags\":{\"a\":\"' || (doc_id % 3) || '\",\"b\":\"' || (doc_id % 5) || '\"}}' AS document, true AS fits FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL")
def fn_15_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON: keys in order at every level, no blanks, 64 KiB at most."""
    tags = F.create_map(F.lit("b"), (F.col("doc_id") % 5).cast("string"), F.lit("a"), (F.col("doc_id") % 3).cast("string"))
    made, fits = tx.document({"tags": tx.in_order(tags), "lang": F.col("lang"), "chars": F.col("n_chars")})
    return table(spark, sf_dir, "documents").where("lang is not null and n_chars is not null").select("doc_id", made.alias("document"), fits.alias("fits"))


@query(
    r"""
SELECT item_id, list_slice(list_filter(list_transform(string_split_regex(replace(text, ', ', '; '), '[?;\n]+'), lambda c: trim(regexp_replace(c, '[ \t\n\r\f\v]+', ' ', 'g'))), lambda c: c <> ''), 1, 4) AS clauses,
 CASE WHEN instr(text, ' ') > 0 THEN substr(text, 1, instr(text, ' ') - 1) ELSE text END AS head, CASE WHEN instr(text, ' ') > 0 THEN substr(text, instr(text, ' ') + 1) ELSE '' END AS tail FROM benchmark"""
)
def fn_03_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a question, and a text before and after its first blank."""
    head, tail = tx.halves(F.col("text"), " ")
    return table(spark, sf_dir, "benchmark").select("item_id", tx.clauses(F.replace("text", F.lit(", "), F.lit("; "))).alias("clauses"), head.alias("head"), tail.alias("tail"))


@query(
    """
WITH a AS (SELECT count(*) AS n FROM conversations), b AS (SELECT CAST(ceil(n / 100) AS BIGINT) AS n FROM a WHERE n > 1), c AS (SELECT CAST(ceil(n / 100) AS BIGINT) AS n FROM b WHERE n > 1), d AS (SELECT CAST(ceil(n / 100) AS BIGINT) AS n FROM c WHERE n > 1)
SELECT 0 AS level, n FROM a UNION ALL SELECT 1, n FROM b UNION ALL SELECT 2, n FROM c UNION ALL SELECT 3, n FROM d"""
)
def rec_06_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan-in of all turns in bundles of a hundred, level upon level, until one bundle holds all: the size of each level."""
    order = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return evidence.levels(evidence.numbered(order, ["conv_id", "turn"]), "place", 100).groupBy("level").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' AND bad THEN NULL ELSE 'of ' || length(text) END AS reasoning FROM (SELECT *, bool_or(conv_id * 5 + turn % 5 IN (SELECT doc_id FROM labels WHERE toxic = 1)) OVER (PARTITION BY conv_id) AS bad, conv_id * 5 + turn % 5 IN (SELECT doc_id FROM labels WHERE toxic = 1) AS dead FROM conversations) WHERE NOT dead")
def flt_27_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's history as it may be read: forgotten turns go, and what was thought in a session that had one is withheld."""
    rows = table(spark, sf_dir, "conversations").withColumn("record_id", F.col("conv_id") * 5 + F.col("turn") % 5).withColumn("reasoning", F.concat(F.lit("of "), F.length("text")))
    dead = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("record_id"))
    return evidence.readable(rows, dead, "conv_id", "record_id", {"reasoning": F.col("role") == "assistant"}).select("conv_id", "turn", "role", "text", "reasoning")


@query("SELECT (SELECT count(*) FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)) AS n_dead, count(*) AS n_records FROM documents")
def flt_03_live_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the cited records are not live: none may be."""
    dead = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0").select("doc_id", F.lit(1).alias("dead")).distinct()
    return table(spark, sf_dir, "documents").join(dead, "doc_id", "left").agg(F.count("dead").alias("n_dead"), F.count("*").alias("n_records"))


@query(
    """
SELECT l_orderkey, l_linenumber, l_shipdate > o_orderdate AS sane FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
)
def flt_10_interval_sane(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import rules

    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", rules.interval_sane(F.col("o_orderdate"), F.col("l_shipdate")).alias("sane"))


@query("SELECT item_id, doc_id, rank FROM (SELECT user_id AS item_id, event_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 20 AND doc_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def flt_07_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded ids leave gaps in the ranks of the raw list."""
    by = Window.partitionBy("item_id").orderBy(F.desc("value"), "doc_id")
    events = table(spark, sf_dir, "events")
    ranked = events.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("doc_id"), "value").withColumn("rank", F.row_number().over(by).cast("long")).where("rank <= 20")
    excluded = events.where("event_type = 'error'").select(F.col("event_id").alias("doc_id"))
    return ranked.join(excluded, "doc_id", "left_anti").select("item_id", "doc_id", "rank")
