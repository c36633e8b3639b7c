"""Queries of queues, lineage states, claims, recall loops and status reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import rules, text as tx
from ..operators import evidence, recall, retrieval
from ..session import table
from .ranking import met
from .registry import query
from .scans import BM25_SQL, bm25_top

_TERMS = (
    r"list_filter(list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')), lambda t: NOT regexp_full_match(t, '\p{{Nd}}+') AND NOT list_contains(string_split('"
    + " ".join(tx.STOP_WORDS)
    + "', ' '), t))"
)


@query(
    BM25_SQL
    + f""", p AS (SELECT r.*, {_TERMS.format("d.text")} AS dt, {_TERMS.format("substr(b.text, 1, 40)")} AS q1, {_TERMS.format("substr(b.text, 41, 60)")} AS q2
 FROM ranked r JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank <= 20)
SELECT item_id, doc_id, len(list_intersect(dt, q1)) > 0 AS main, len(q2) > 0 AND len(list_intersect(dt, q2)) >= least(2, len(q2)) AS other, rank <= 3 AND list_cosine_similarity(a.embedding, b.embedding) >= 0.1 AS near
FROM p LEFT JOIN embeddings a ON a.vec_id = item_id LEFT JOIN embeddings b ON b.vec_id = doc_id WHERE a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL"""
)
def flt_14_intent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stricter gate of branches: one term of the main query, two (or all) of a variant, or a similarity at a floor."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.content_terms(F.substring("text", 1, 40)).alias("q1"), tx.content_terms(F.substring("text", 41, 60)).alias("q2"))
    pool = bm25_top(spark, sf_dir, 20)
    docs = met(table(spark, sf_dir, "documents"), pool).select("doc_id", tx.content_terms("text").alias("dt"))
    both = pool.join(docs, "doc_id").join(items, "query_id")
    main, other = recall.intent(F.col("dt"), F.col("q1"), F.col("q2"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    held = both.join(vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("a")), "query_id").join(vectors.select(F.col("vec_id").alias("doc_id"), F.col("v").alias("b")), "doc_id")
    near = (F.col("rank") <= 3) & F.coalesce(tx.cosine("a", "b") >= 0.1, F.lit(False))
    return held.select(F.col("query_id").alias("item_id"), "doc_id", main.alias("main"), other.alias("other"), near.alias("near"))


@query(
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderdate <= TIMESTAMP '1997-01-01' WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 60 DAY <= TIMESTAMP '1997-01-01' ELSE false END AS claimable FROM orders"""
)
def flt_22_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due retries and expired leases may be claimed; what is delivered may not."""
    state = F.when(F.col("o_orderstatus") == "P", "retry_wait").when(F.col("o_orderstatus") == "O", "leased").otherwise("complete")
    due = F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).otherwise(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", recall.claimable(state, due, F.expr("TIMESTAMP '1997-01-01'")).alias("claimable"))


@query(
    """
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents x USING (doc_id) WHERE l.toxic = 1 AND x.source = d.source AND x.lang = d.lang AND x.doc_id % 10 = d.doc_id % 10)
 AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"""
)
def flt_29_item_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones of a whole item (source, language, last digit) and of one revision."""
    docs, labels = table(spark, sf_dir, "documents").withColumn("item", F.concat_ws("/", "source", "lang", (F.col("doc_id") % 10).cast("string"))), table(spark, sf_dir, "labels")
    items = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").select("item")
    return evidence.live(evidence.live(docs, items, "item"), labels.where("quality = 0"), "doc_id").select("doc_id")


@query(
    """
SELECT c.c_custkey, n.n_name, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey < 3
LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT'
WHERE contains(lower(c.c_mktsegment), 'mach') OR EXISTS (SELECT 1 FROM orders a JOIN lineitem l ON l.l_orderkey = a.o_orderkey WHERE a.o_custkey = c.c_custkey AND l.l_quantity = 50) GROUP BY 1, 2"""
)
def join_04_entities_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by label, or by an alias in a record (here: a large order), with what is known of them; outer joins keep the
    others. Counts are summed before the join.
    """
    places = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    orders = table(spark, sf_dir, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    large = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    alias = orders.join(large, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("alias", F.lit(True))
    named = table(spark, sf_dir, "customer").join(alias, "c_custkey", "left").where(tx.literal_contains("c_mktsegment", "mach") | F.col("alias"))
    held = named.join(places, "c_nationkey", "left").join(urgent, "c_custkey", "left")
    return held.select("c_custkey", "n_name", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"))


@query(
    """
SELECT DISTINCT o.o_custkey, o.o_orderkey, o.o_orderdate FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity >= 30
QUALIFY dense_rank() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey) <= 3"""
)
def join_09_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest records linked to each entity, each once."""
    linked = table(spark, sf_dir, "lineitem").where("l_quantity >= 30").select(F.col("l_orderkey").alias("o_orderkey"))
    held = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").join(linked, "o_orderkey", "left_semi")
    return evidence.first_per_key(held, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    """
SELECT o.o_orderkey, o.o_orderstatus, NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus <> 'F') AS ready,
 (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus <> 'F') AS n_blocking FROM orders o"""
)
def join_12_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose dependencies are all complete are ready."""
    waiting = table(spark, sf_dir, "lineitem").where("l_linestatus != 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return table(spark, sf_dir, "orders").join(waiting, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", (n == 0).alias("ready"), n.alias("n_blocking"))


@query(
    """
SELECT e.event_id, c.conv_id FROM events e JOIN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') c ON CAST(json_extract(e.props, '$.k') AS BIGINT) = c.conv_id"""
)
def join_15_json_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on a key inside a JSON payload."""
    keyed = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("conv_id")).where("conv_id is not null")
    return keyed.join(table(spark, sf_dir, "conversations").where("role = 'system'").select("conv_id").distinct(), "conv_id").select("event_id", "conv_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE 'job_' || e.vec_id || '_' || (e.label % 2) = 'job_' || d.doc_id || '_' || (d.doc_id % 2))")
def join_17_computed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda a, b: F.concat(F.lit("job_"), a, F.lit("_"), b)
    jobs = table(spark, sf_dir, "embeddings").select(key(F.col("vec_id"), F.col("label") % 2).alias("k"))
    return table(spark, sf_dir, "documents").withColumn("k", key(F.col("doc_id"), F.col("doc_id") % 2)).join(jobs, "k", "left_anti").select("doc_id")


@query("SELECT e.event_id, e.user_id FROM events e WHERE e.event_id > (SELECT max(event_id) - 500 FROM events) AND e.user_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def join_18_past_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    mark = events.agg(F.max("event_id")).first()[0]
    hidden = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("user_id"))
    return events.where(F.col("event_id") > (mark or 0) - 500).join(hidden, "user_id", "left_anti").select("event_id", "user_id")


@query(
    """
SELECT r.o_orderkey, count(*) AS n_refs, count(*) FILTER (WHERE l.l_returnflag = 'R') AS n_dead, bool_or(l.l_returnflag = 'R') AS redacted FROM orders r JOIN lineitem l ON l.l_orderkey = r.o_orderkey GROUP BY 1"""
)
def join_20_change_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their references' states: summed by event before they meet the log."""
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_refs"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_dead"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(refs, "o_orderkey").withColumn("redacted", F.col("n_dead") > 0)


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1")
def join_22_result_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return evidence.latest(rows, ["l_partkey"], F.struct("l_shipdate", "l_orderkey", "l_linenumber")).select("l_orderkey", "l_partkey", "l_linenumber")


@query(
    """
SELECT l.doc_id, m.model FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l, (SELECT DISTINCT label AS model FROM embeddings) m
WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = l.doc_id AND e.label = m.model)"""
)
def join_24_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each model has still to index again, of the records signalled by a poor review."""
    vectors = table(spark, sf_dir, "embeddings")
    signals = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return recall.obligations(signals, vectors.select(F.col("label").alias("model")), vectors.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("model")))


@query(
    """
SELECT v.vec_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'forgotten' WHEN d.doc_id IS NULL THEN 'unknown' ELSE 'live' END AS state
FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = v.vec_id"""
)
def join_26_lineage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(True).alias("known"))
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("gone"))
    state = F.when(F.col("gone"), "forgotten").when(F.col("known").isNull(), "unknown").otherwise("live")
    return parents.join(known, "id", "left").join(gone, "id", "left").select("id", state.alias("state"))


@query(
    """
WITH entry AS (SELECT o_custkey AS entry, list(o_orderkey) AS evidence FROM orders GROUP BY 1)
SELECT entry, count(*) AS n_touched FROM (SELECT entry, unnest(evidence) AS r FROM entry) WHERE r IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) GROUP BY entry"""
)
def join_28_depending_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a retired record among the ids they hold."""
    held = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entry"), F.col("o_orderkey").alias("r"))
    retired = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("r"))
    return held.join(retired, "r", "left_semi").groupBy("entry").agg(F.count("*").alias("n_touched"))


@query(
    """
SELECT source, count(*) AS n_records, count(l.doc_id) AS n_reviewed, count(*) FILTER (WHERE l.toxic = 1) AS n_failing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source"""
)
def agg_08_source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("seen"), "toxic"), "doc_id", "left")
    return held.groupBy("source").agg(F.count("*").alias("n_records"), F.count("seen").alias("n_reviewed"), F.count(F.when(F.col("toxic") == 1, 1)).alias("n_failing"))


@query("SELECT DISTINCT source, lang, doc_id % 10 AS item FROM documents")
def agg_16_reset_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", "lang", (F.col("doc_id") % 10).alias("item")).distinct()


@query("SELECT user_id, arg_max(event_type, event_id) AS signal, max(event_id) AS event_id FROM events GROUP BY user_id")
def agg_17_newest_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("signal"), F.max("event_id").alias("event_id"))


@query("SELECT label AS model FROM embeddings UNION SELECT quality FROM labels UNION SELECT toxic FROM labels")
def set_03_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("model")).union(labels.select("quality")).union(labels.select("toxic")).distinct()


@query("SELECT o_orderkey AS id, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS BIGINT) AS bundle FROM orders")
def rec_06_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's lineage in bundles of bounded fan-in."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.floor((F.row_number().over(by) - 1) / 4).alias("bundle"))


@query(
    """
WITH c AS (SELECT event_id AS id, user_id AS subject, event_type AS predicate, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS next_id FROM events)
SELECT id, CASE WHEN subject IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'retracted' WHEN next_id IS NOT NULL THEN 'superseded' ELSE 'active' END AS status FROM c"""
)
def knw_01_claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim's status follows from the log: retracted with its evidence, superseded by the next of its subject and predicate."""
    claims = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("subject"), "event_type")
    later = F.lead("id").over(Window.partitionBy("subject", "event_type").orderBy("id"))
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("subject"), F.lit(True).alias("gone")).distinct()
    status = F.when(F.col("gone"), "retracted").when(F.col("later").isNotNull(), "superseded").otherwise("active")
    return claims.withColumn("later", later).join(gone, "subject", "left").select("id", status.alias("status"))


@query("SELECT conv_id, count(*) AS n_records, sha256(string_agg(sha256(text), '' ORDER BY turn)) AS fingerprint FROM conversations GROUP BY conv_id")
def knw_08_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen snapshots of conversations: the number of their turns and one digest of their contents."""
    named = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.col("text").cast("binary"), 256).alias("d"))
    return evidence.snapshots(named, "conv_id", "turn", "d")


@query("SELECT doc_id, substr(text, 1, 500) AS summary FROM documents WHERE length(trim(text)) > 0")
def knw_16_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0).select("doc_id", F.substring("text", 1, 500).alias("summary"))


@query("SELECT event_id, 'events:' || CASE WHEN json_extract(props, '$.k') IS NOT NULL AND CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) ELSE event_type || ':' || user_id END AS grp FROM events")
def str_05_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of an event: its conversation where it has one, else its stream and item."""
    k = F.get_json_object("props", "$.k").cast("long")
    conversation = F.when(k % 2 == 0, k.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", recall.group_key(F.lit("events"), conversation, F.col("event_type"), F.col("user_id").cast("string")).alias("grp"))


@query(
    """
SELECT event_id, coalesce(event_id < max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM events"""
)
def str_16_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late arrivals are flagged and kept; no watermark drops them."""
    before = F.max("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.col("event_id") < before, F.lit(False)).alias("late"))


@query(
    BM25_SQL
    + """, hit AS (SELECT item_id, count(*) AS n FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 10 AND d.source = 'src7' GROUP BY 1)
SELECT b.item_id, coalesce(n, 0) AS n_episodes, CASE WHEN n > 0 THEN 'candidates_found' WHEN b.item_id % 9 = 0 THEN 'retrieval_incomplete' ELSE 'no_relevant_evidence' END AS status FROM benchmark b LEFT JOIN hit USING (item_id)"""
)
def ret_06_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search can say: an engine's failure (here: every ninth query's) is not absence."""
    kept = table(spark, sf_dir, "documents").where("source = 'src7'").select("doc_id")
    hits = bm25_top(spark, sf_dir, 10).join(kept, "doc_id", "left_semi").groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(hits, "item_id", "left").select("item_id", n.alias("n_episodes"), recall.status(n, F.col("item_id") % 9 == 0).alias("status"))


@query(
    BM25_SQL
    + f""", stage AS (SELECT *, CASE WHEN rank <= 32 THEN 0 WHEN rank <= 96 THEN 1 ELSE 2 END AS s FROM ranked WHERE rank <= 256),
live AS (SELECT st.*, trim(regexp_replace(d.text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS norm FROM stage st JOIN documents d USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
one AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY item_id, norm ORDER BY rank) = 1),
per AS (SELECT item_id, s, count(*) AS n FROM one GROUP BY 1, 2),
tot AS (SELECT item_id, coalesce(max(CASE WHEN s = 0 THEN n END), 0) AS n0, coalesce(max(CASE WHEN s = 1 THEN n END), 0) AS n1, coalesce(max(CASE WHEN s = 2 THEN n END), 0) AS n2 FROM per GROUP BY 1)
SELECT item_id, CAST(CASE WHEN n0 >= 30 THEN 1 WHEN n1 = 0 OR n0 + n1 >= 30 THEN 2 ELSE 3 END AS INTEGER) AS rounds,
 CAST(CASE WHEN n0 >= 30 THEN n0 WHEN n1 = 0 OR n0 + n1 >= 30 THEN n0 + n1 ELSE n0 + n1 + n2 END AS BIGINT) AS n_found,
 CASE WHEN n0 >= 30 OR n0 + n1 >= 30 THEN 'enough' WHEN n1 = 0 THEN 'nothing_new' WHEN n0 + n1 + n2 >= 30 THEN 'enough' ELSE 'last_stage' END AS reason FROM tot"""
)
def ret_07_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fast, balanced, deep: each query stops at the first stage with 30 different texts, or one that adds nothing."""
    docs = evidence.live(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    keyed = docs.select("doc_id", F.sha2(tx.squeezed("text").cast("binary"), 256).alias("norm"))
    pool = bm25_top(spark, sf_dir, retrieval.POOLS["deep"]).join(keyed, "doc_id")
    return recall.adaptive(pool, "norm", 30).select(F.col("query_id").alias("item_id"), "rounds", "n_found", "reason")


@query("SELECT c_custkey, 'customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS clean, '+44' || lpad(CAST(c_custkey AS VARCHAR), 10, '7') AS phone FROM customer")
def fn_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts in normal form: addresses with folded domains, phone numbers without punctuation."""
    rows = table(spark, sf_dir, "customer")
    address = F.concat(F.lit("x@"), "c_name")
    number = F.concat(F.lit("+44 (7"), F.substring(F.lpad(F.col("c_custkey").cast("string"), 10, "7"), 2, 3), F.lit(") "), F.substring(F.lpad(F.col("c_custkey").cast("string"), 10, "7"), 5, 6))
    return rows.select("c_custkey", F.substring(tx.email(address), F.lit(3), F.length("c_name")).alias("clean"), tx.phone(number).alias("phone"))
