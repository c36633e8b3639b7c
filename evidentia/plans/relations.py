"""Queries of joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import rules, text as tx
from ..operators import evidence, graph, knowledge
from ..session import spread, table
from .registry import query


@query(
    """
WITH links AS (SELECT c_custkey AS k, TIMESTAMP '1994-01-01' + to_days(CAST(c_nationkey * 30 AS INTEGER)) AS f, TIMESTAMP '1994-01-01' + to_days(CAST(c_nationkey * 30 + 700 AS INTEGER)) AS t FROM customer WHERE c_custkey % 3 <> 0),
direct AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0)
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM direct WHERE k = o_custkey)
 OR EXISTS (SELECT 1 FROM links WHERE k = o_custkey AND f <= o_orderdate AND o_orderdate < t)"""
)
def join_05_related_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer")
    start = F.expr("timestampadd(DAY, cast(c_nationkey * 30 as int), TIMESTAMP '1994-01-01')")
    links = customers.where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("k"), start.alias("f"), F.expr("timestampadd(DAY, cast(c_nationkey * 30 + 700 as int), TIMESTAMP '1994-01-01')").alias("t"))
    direct = orders.join(customers.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    valid = orders.join(links, (F.col("o_custkey") == F.col("k")) & rules.valid_at(F.col("f"), F.col("t"), F.col("o_orderdate")), "left_semi")
    return direct.select("o_orderkey").union(valid.select("o_orderkey")).distinct()


@query(
    """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS person, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS f, CASE WHEN o_orderkey % 40 <> 0 THEN o_orderdate + INTERVAL 30 DAY END AS t FROM orders)
SELECT a.o_orderkey, count(b.o_orderkey) AS overlaps FROM o a LEFT JOIN o b ON b.o_custkey = a.o_custkey AND b.person <> a.person
 AND (b.t IS NULL OR a.f IS NULL OR b.t > a.f) AND (a.t IS NULL OR b.f IS NULL OR b.f < a.t) GROUP BY 1"""
)
def join_07_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of ownership of an account (customer) that meet those of other persons (priorities); some are open."""
    start = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate"))
    end = F.when(F.col("o_orderkey") % 40 != 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", start.alias("f"), end.alias("t"))
    return knowledge.overlapping(orders, "o_custkey", "o_orderpriority", "f", "t", "o_orderkey").select("o_orderkey", "overlaps")


@query(
    """
SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""
)
def join_08_identity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    named = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query(
    """
WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 's' || l_suppkey AS b FROM lineitem WHERE l_quantity > 45),
s AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderkey % 20 = 0 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0)
SELECT id, other FROM (SELECT id, b AS other FROM s JOIN e ON e.a = s.id UNION SELECT id, a FROM s JOIN e ON e.b = s.id)"""
)
def join_11_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entities are related to, met from either end: two equi-joins in place of an OR."""
    edges = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    seeds = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id")).union(table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.concat(F.lit("s"), "s_suppkey")))
    return graph.related(edges, seeds)


@query(
    """
SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (
  SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F')"""
)
def join_13_due_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(done, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT user_id, event_type, event_id, ts FROM events e WHERE event_id = (SELECT max(event_id) FROM events m WHERE m.user_id = e.user_id AND m.event_type = e.event_type)")
def join_19_latest_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], F.col("event_id"))


@query(
    """
SELECT doc_id AS id, 'missing' AS state FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)
UNION ALL SELECT vec_id, 'orphan' FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE e.vec_id = d.doc_id)"""
)
def join_23_reconcile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    missing = docs.join(vectors, "id", "left_anti").select("id", F.lit("missing").alias("state"))
    return missing.union(vectors.join(docs, "id", "left_anti").select("id", F.lit("orphan").alias("state")))


@query(
    """
WITH state AS (SELECT o_custkey, CASE WHEN bool_and(o_orderstatus <> 'O') THEN 'complete' ELSE 'partial' END AS state FROM orders GROUP BY 1)
SELECT n.n_name AS domain, count(*) AS n_required, count(*) FILTER (WHERE coalesce(s.state = 'complete', false)) AS n_complete, bool_and(coalesce(s.state = 'complete', false)) AS covered
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN state s ON s.o_custkey = c.c_custkey GROUP BY 1"""
)
def join_27_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.when(F.bool_and(F.col("o_orderstatus") != "O"), "complete").otherwise("partial").alias("state"))
    required = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("domain"), F.col("c_custkey").alias("source"))
    return knowledge.covered(required, states, "domain", "source")


@query(
    """
WITH l AS (SELECT l_orderkey AS record, l_partkey AS entity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS n FROM lineitem),
h AS (SELECT record // 100 AS job, entity, min(record) AS record FROM l WHERE n <= 8 GROUP BY 1, 2)
SELECT job, entity, p_name, place FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY record, entity) AS place FROM h) JOIN part ON p_partkey = entity WHERE place <= 64"""
)
def join_29_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for a job on a hundred records: eight entities a record, each once, sixty-four in all."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_partkey").alias("entity"), "l_linenumber")
    few = evidence.first_per_key(links, ["record"], [F.col("entity"), F.col("l_linenumber")], 8)
    once = few.groupBy(F.expr("record div 100").alias("job"), "entity").agg(F.min("record").alias("record"))
    place = F.row_number().over(Window.partitionBy("job").orderBy("record", "entity")).cast("long")
    kept = once.withColumn("place", place).where("place <= 64")
    return kept.join(table(spark, sf_dir, "part"), F.col("entity") == F.col("p_partkey")).select("job", "entity", "p_name", "place")


@query(
    """
SELECT user_id, event_type, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 9) AS mean FROM events
WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) GROUP BY user_id, event_type"""
)
def agg_01_measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    low = events.agg(F.min("ts") + F.expr("INTERVAL 1 DAY")).first()[0]
    held = events.where(rules.within(F.col("ts"), F.lit(low), None))
    return held.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.round(F.avg("value"), 9).alias("mean"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def agg_02_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_records, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, max(doc_id) AS generation, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents")
def agg_03_store_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_records"), F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_langs"), F.max("doc_id").alias("generation"), F.sum(F.length("text").cast("long")).alias("n_chars"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, max(event_id) AS high_water FROM events GROUP BY 1, 2")
def agg_04_journal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.max("event_id").alias("high_water"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, min(ts) AS oldest FROM events GROUP BY event_type")
def agg_05_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.min("ts").alias("oldest"))


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) = 0")
def agg_07_having_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("active")).where("active = 0").select("o_custkey")


@query(
    """
SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings)) AS n_known,
 (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n_pending,
 (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS n_retired"""
)
def agg_09_index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("d"), F.lit(0).alias("v"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("d"), F.lit(1).alias("v"))
    each = docs.union(vectors).groupBy("id").agg(F.max("d").alias("d"), F.max("v").alias("v"))
    return each.agg(F.count("*").alias("n_known"), F.count(F.when(F.col("v") == 0, 1)).alias("n_pending"), F.count(F.when(F.col("d") == 0, 1)).alias("n_retired"))


@query(
    """
SELECT user_id, event_type, count(DISTINCT CAST(floor(value) AS BIGINT)) AS n_values, count(*) AS n_beliefs FROM events
GROUP BY user_id, event_type HAVING count(DISTINCT CAST(floor(value) AS BIGINT)) > 1"""
)
def agg_11_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    beliefs = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor("value").alias("v"))
    return knowledge.conflicts(beliefs, ["user_id", "event_type"], "v")


@query(
    """
SELECT user_id, coalesce(min(event_id) FILTER (WHERE event_type = 'error') - 1, max(event_id) FILTER (WHERE event_type <> 'error')) AS done_through FROM events GROUP BY user_id"""
)
def agg_14_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_, done = F.when(F.col("event_type") == "error", F.col("event_id")), F.when(F.col("event_type") != "error", F.col("event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.min(open_) - 1, F.max(done)).alias("done_through"))


@query(
    """
SELECT o_custkey, bool_and(o_totalprice > 1000) AS passed, list_sort(list(DISTINCT o_orderpriority)) AS seen,
 len(list_intersect(list(DISTINCT o_orderpriority), ['1-URGENT', '2-HIGH'])) = 2 AS covered FROM orders GROUP BY o_custkey"""
)
def agg_15_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    each = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") > 1000).alias("passed"), F.sort_array(F.collect_set("o_orderpriority")).alias("seen"))
    return each.withColumn("covered", F.size(F.array_except(needed, F.col("seen"))) == 0)


@query("SELECT role, sha256(text) AS digest, count(*) AS n FROM conversations GROUP BY 1, 2")
def agg_18_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"))


@query("SELECT source, CAST(sum(length(text)) AS BIGINT) AS used, least(100, CAST(floor(100 * sum(length(text)) / 200000) AS BIGINT)) AS percent FROM documents GROUP BY source")
def agg_20_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length("text").cast("long")).alias("used"))
    return used.withColumn("percent", F.least(F.lit(100).cast("long"), F.floor(F.col("used") * 100 / 200_000)))


@query("SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0")
def set_01_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.where("toxic = 1").select("doc_id").union(labels.where("quality = 0").select("doc_id")).distinct()


@query("SELECT max(v) AS clock FROM (SELECT max(event_id) AS v FROM events UNION ALL SELECT max(o_orderkey) FROM orders)")
def set_02_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").agg(F.max("event_id").alias("v"))
    return events.unionAll(table(spark, sf_dir, "orders").agg(F.max("o_orderkey"))).agg(F.max("v").alias("clock"))


@query("SELECT c_custkey AS key FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_04_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return allowed.intersect(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT doc_id FROM labels WHERE quality = 0 EXCEPT SELECT doc_id FROM documents WHERE lang = 'en'")
def set_05_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return hidden.subtract(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"))


_NORMAL = r"trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))"


@query(f"SELECT first, list_sort(list(doc_id) FILTER (WHERE doc_id <> first)) AS duplicates FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_NORMAL}) AS first FROM documents) GROUP BY first HAVING count(*) > 1")
def win_07_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that a record stands for, all in one list by group."""
    return evidence.duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", tx.squeezed("text"))


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {_NORMAL}) AS first, doc_id <> min(doc_id) OVER (PARTITION BY {_NORMAL}) AS is_duplicate FROM documents")
def win_07_dup_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.collapsed(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", tx.squeezed("text"))
