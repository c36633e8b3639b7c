"""Queries of the change journal's consumers: probes, packets, retention, deliveries, progress and health.

Events are the journal; users are consumers, and days stand for groups of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import awareness
from ..session import table
from .registry import query


@query(
    """
WITH c AS (SELECT user_id AS consumer, max(event_id) FILTER (WHERE event_type <> 'view') AS cursor, 1 + user_id % 2 AS epoch, user_id % 17 = 0 AS resync FROM events GROUP BY user_id),
free AS (SELECT DISTINCT user_id AS consumer, 1 + event_id % 2 AS epoch FROM events WHERE event_type = 'error' OR (event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-10')),
top AS (SELECT 1 + event_id % 2 AS epoch, max(event_id) AS top FROM events GROUP BY 1)
SELECT c.consumer, f.consumer IS NOT NULL AS claimable, coalesce(top > cursor, false) AS unscanned, f.consumer IS NOT NULL OR coalesce(top > cursor, false) OR resync AS pending
FROM c LEFT JOIN free f USING (consumer, epoch) LEFT JOIN top USING (epoch)"""
)
def str_07_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run of a consumer is worth while: a batch to claim, events not scanned, or a resync."""
    events, epoch = table(spark, sf_dir, "events"), 1 + F.col("event_id") % 2
    consumers = events.groupBy(F.col("user_id").alias("consumer")).agg(F.max(F.when(F.col("event_type") != "view", F.col("event_id"))).alias("cursor")).withColumn("epoch", 1 + F.col("consumer") % 2).withColumn("resync", F.col("consumer") % 17 == 0)
    state = F.when(F.col("event_type") == "error", "pending").when(F.col("event_type") == "purchase", "retry_wait").otherwise("complete")
    batches = events.select(F.col("user_id").alias("consumer"), epoch.alias("epoch"), state.alias("state"), F.col("ts").alias("until"))
    return awareness.pending(consumers, batches, events.select(epoch.alias("epoch"), F.col("event_id").alias("seq")), F.expr("TIMESTAMP '2024-01-10'"))


def _skip_sql(source: str, most: int, budget: int) -> str:
    """SQL of the skip rule over source (key, seq, chars): the seqs taken of each key."""
    return f"""SELECT key, unnest(list_reduce(list_prepend({{'n': 0, 'used': 0::BIGINT, 'taken': []::BIGINT[]}}, list({{'n': 1, 'used': chars, 'taken': [seq]}} ORDER BY seq)),
 lambda a, x: CASE WHEN a.n >= {most} OR a.used + x.used > {budget} THEN a ELSE {{'n': a.n + 1, 'used': a.used + x.used, 'taken': list_concat(a.taken, x.taken)}} END).taken) AS seq FROM ({source}) GROUP BY key"""


_GROUPS = "SELECT user_id AS key, min(event_id) AS seq, CAST(sum(length(props) + 300) AS BIGINT) AS chars FROM events WHERE event_type <> 'view' GROUP BY user_id, CAST(ts AS DATE)"


@query(_skip_sql(f"SELECT * FROM ({_GROUPS}) WHERE seq % 5 <> 0", 8, 4000))
def str_08_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next packet of each session: groups that were not exposed to it, in order, as far as each one fits."""
    events = table(spark, sf_dir, "events").where("event_type != 'view'")
    groups = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("seq"), F.sum(F.length("props") + 300).cast("long").alias("chars")).select(F.col("user_id").alias("key"), "seq", "chars")
    exposed = groups.where("seq % 5 = 0").select("key", "seq")
    return awareness.packets(groups, exposed, "key", "seq", "seq", "chars").select("key", "seq")


@query(_skip_sql("SELECT source AS key, doc_id AS seq, length(text) AS chars FROM documents WHERE text IS NOT NULL", 30, 16000))
def win_05_budget_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skip rule of a budget of characters, by source."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("key"), F.col("doc_id").alias("seq"), F.length("text").cast("long").alias("chars"))
    return awareness.fitted(rows, "key", "seq", "chars", 30, 16_000).select("key", "seq")


_LATE = """
WITH t AS (SELECT max(event_id) // 2 AS through FROM events),
c AS (SELECT user_id AS consumer, max(event_id) AS cursor, min(event_id) AS done_through FROM events GROUP BY user_id),
u AS (SELECT user_id AS consumer, event_id AS seq_from FROM events WHERE event_type = 'error')
"""


@query(
    _LATE
    + """SELECT 'log' AS kind, event_id AS id FROM events, t WHERE event_id > through
UNION ALL SELECT DISTINCT 'resync', consumer FROM (SELECT consumer FROM c, t WHERE cursor < through OR done_through < through UNION SELECT consumer FROM u, t WHERE seq_from <= through)"""
)
def str_12_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log cut half way, and the consumers that must read anew because of it."""
    events = table(spark, sf_dir, "events")
    through = (events.agg(F.max("event_id")).first()[0] or 0) // 2
    consumers = events.groupBy(F.col("user_id").alias("consumer")).agg(F.max("event_id").alias("cursor"), F.min("event_id").alias("done_through"))
    unfinished = events.where("event_type = 'error'").select(F.col("user_id").alias("consumer"), F.col("event_id").alias("seq_from"))
    left, late = awareness.compacted(events.select(F.col("event_id").alias("seq")), consumers, unfinished, through)
    return left.select(F.lit("log").alias("kind"), F.col("seq").alias("id")).union(late.select(F.lit("resync"), "consumer"))


@query(
    """
WITH q AS (SELECT user_id, event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS priority, max_by(event_type, event_id) OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, event_id, event_type FROM q QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = last)::INT, priority, event_id) = 1"""
)
def win_10_fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next of each consumer: of another source than the last one if there is any, then by priority, then the oldest."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.get_json_object("props", "$.k").cast("long") % 4).alias("priority"))
    last = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"))
    return awareness.fairest(events.join(last, "user_id"), "user_id", "last", "event_type", "priority", "event_id").select("user_id", "event_id", "event_type")


@query(
    """
WITH p AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'gap' WHEN 'view' THEN 'pending' ELSE 'complete' END AS state, CASE WHEN user_id % 2 = 0 THEN 'backfill' ELSE 'incremental' END AS mode, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS later FROM events)
SELECT user_id, event_id, CASE WHEN state = 'gap' THEN 'sync_gap' WHEN mode = 'backfill' AND later IS NULL AND state = 'complete' THEN 'backfill_complete' WHEN mode = 'backfill' THEN 'backfill_progress' END AS event FROM p"""
)
def str_03_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "gap").when(F.col("event_type") == "view", "pending").otherwise("complete")
    pages = table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state"), F.when(F.col("user_id") % 2 == 0, "backfill").otherwise("incremental").alias("mode"))
    return awareness.progress(pages, "user_id", "event_id").select("user_id", "event_id", "event")


@query(
    """
SELECT 'evt_' || substr(sha256('enrichment|' || event_id), 1, 24) AS id, event_id AS cause_event_id, event_type AS source, user_id AS item, 'enrichment' AS kind FROM events
WHERE event_id IN (SELECT CAST(json_extract(props, '$.k') AS BIGINT) FROM events WHERE value > 50)"""
)
def str_10_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that bear on an event add one linked event to the log, however many they are."""
    events = table(spark, sf_dir, "events")
    results = events.select(F.get_json_object("props", "$.k").cast("long").alias("event_id"), (F.col("value") > 50).alias("material"))
    return awareness.enrichments(results, events.select("event_id", F.col("event_type").alias("source"), F.col("user_id").alias("item")))


@query("SELECT event_type AS stage, count(*) AS n, count(DISTINCT user_id) AS n_records, max(ts) AS latest FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 60 GROUP BY 1")
def agg_06_failing_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").cast("long") > 60)
    return failed.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_records"), F.max("ts").alias("latest"))


@query(
    """
SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS queued, count(*) FILTER (WHERE o_orderstatus = 'P') AS retrying, count(*) FILTER (WHERE o_orderstatus = 'F') AS dead,
 min(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS oldest, coalesce(max(CASE WHEN o_orderstatus = 'P' THEN least(300, 2 ** least(o_orderkey % 10 + 1, 8)) END), 0)::BIGINT AS longest_wait FROM orders"""
)
def agg_19_outbox_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits in an outbox, how long the oldest has, and the longest pause before a retry."""
    from ..functions import rules

    at = lambda s: F.col("o_orderstatus") == s
    wait = rules.backoff(F.least(F.col("o_orderkey") % 10 + 1, F.lit(8)), 1, 300)
    orders = table(spark, sf_dir, "orders")
    return orders.agg(F.count(F.when(at("O"), 1)).alias("queued"), F.count(F.when(at("P"), 1)).alias("retrying"), F.count(F.when(at("F"), 1)).alias("dead"), F.min(F.when(at("O"), F.col("o_orderdate"))).alias("oldest"), F.coalesce(F.max(F.when(at("P"), wait)), F.lit(0).cast("long")).alias("longest_wait"))


@query(
    """
SELECT o_custkey, event_type, count(*) AS n_batches, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done, sum(o_orderkey % 5)::BIGINT AS attempts, count(DISTINCT o_orderkey // 10) AS n_packets, min(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS oldest_pending
FROM orders JOIN (SELECT DISTINCT user_id, event_type FROM events) e ON e.user_id = o_custkey GROUP BY 1, 2"""
)
def agg_05_awareness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consumer's batches by state, attempts, different packets and the oldest pending one: summed up before the join."""
    each = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_batches"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_done"), F.sum(F.col("o_orderkey") % 5).alias("attempts"), F.count_distinct(F.expr("o_orderkey div 10")).alias("n_packets"), F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))).alias("oldest_pending"))
    kinds = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"), "event_type").distinct()
    return each.join(kinds, "o_custkey").select("o_custkey", "event_type", "n_batches", "n_done", "attempts", "n_packets", "oldest_pending")


@query("SELECT l.l_orderkey AS batch, l.l_linenumber AS place, e.event_id, e.event_type FROM lineitem l JOIN events e ON e.event_id = l.l_partkey WHERE l.l_returnflag = 'R'")
def join_21_batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of frozen batches, as the log has them."""
    members = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("event_id"))
    return members.join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").select("batch", "place", "event_id", "event_type")


@query(
    """
SELECT o_orderkey AS delivery, l_linenumber AS result, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE year(l_shipdate) = (SELECT max(year(o_orderdate)) FROM orders) AND o_orderstatus <> 'F'"""
)
def join_30_current_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries with their results of the current epoch (here: the last year of orders)."""
    orders = table(spark, sf_dir, "orders")
    epoch = orders.agg(F.max(F.year("o_orderdate"))).first()[0]
    results = table(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == F.lit(epoch)).select(F.col("l_orderkey").alias("delivery"), F.col("l_linenumber").alias("result"), "l_partkey")
    return orders.where("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("delivery")).join(results, "delivery").select("delivery", "result", "l_partkey")


@query(
    """
SELECT doc_id AS id, 'retain' AS action FROM documents WHERE source IN ('src1', 'src2') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 3)
UNION ALL SELECT vec_id, 'delete' FROM embeddings WHERE label < 3 AND vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
)
def join_25_external_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another index has still to take of the allowed sources, and to give up."""
    held = table(spark, sf_dir, "embeddings").where("label < 3").select(F.col("vec_id").alias("id"))
    dead = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    wanted = table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2")).select(F.col("doc_id").alias("id")).join(dead, "id", "left_anti").join(held, "id", "left_anti")
    return wanted.select("id", F.lit("retain").alias("action")).union(held.join(dead, "id", "left_semi").select("id", F.lit("delete")))


@query(
    """
SELECT o_orderkey AS event_id, coalesce(list_sort(list(l_partkey) FILTER (WHERE l_returnflag <> 'A')), []) AS record_ids, coalesce(list_sort(list(l_partkey) FILTER (WHERE l_returnflag = 'A')), []) AS previous_record_ids, count(*) AS n
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0) GROUP BY 1"""
)
def src_25_event_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live and visible references of every event, by role; an event has few, by its contract."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0").select(F.col("doc_id").alias("l_suppkey"))
    refs = table(spark, sf_dir, "lineitem").join(gone, "l_suppkey", "left_anti").select(F.col("l_orderkey").alias("event_id"), "l_partkey", "l_returnflag")
    ids = lambda rule: F.sort_array(F.collect_list(F.when(rule, F.col("l_partkey"))))
    return refs.groupBy("event_id").agg(ids(F.col("l_returnflag") != "A").alias("record_ids"), ids(F.col("l_returnflag") == "A").alias("previous_record_ids"), F.count("*").alias("n"))


@query(
    """
SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = e.event_type AND r.event_id % 2 = e.event_id % 2 AND floor(r.value) = floor(e.value) AND r.event_id < e.event_id)"""
)
def flt_28_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a session has not yet retained at this epoch under this fingerprint: the first of each."""
    key = ["user_id", "event_type", "epoch", "print"]
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 2).alias("epoch"), F.floor("value").alias("print"))
    return rows.groupBy(*key).agg(F.min("event_id").alias("event_id")).select("event_id")
