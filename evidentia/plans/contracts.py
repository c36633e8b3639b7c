"""Queries of nested documents, of intervals that meet, and of identities at an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import documents
from ..operators import intervals
from ..schema import judged_batches
from ..session import table
from .registry import query


@query(
    """
WITH d AS (SELECT event_id, '{"at":"' || user_id || '","props":' || CASE WHEN props IS NULL THEN 'null' ELSE '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' END || ',"z":[' || event_id || '.50,{"a":null,"b":"' || event_type || '"}]}' AS document FROM events)
SELECT event_id, document, sha256(document) AS digest FROM d"""
)
def fn_06_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form and digest of nested JSON, with the events' own properties inside."""
    text = lambda c: F.col(c).cast("string")
    made = F.concat(F.lit('{"z": ['), text("event_id"), F.lit('.50, {"b": "'), F.col("event_type"), F.lit('", "a": null}],\n "props": '), F.coalesce("props", F.lit("null")), F.lit(' , "at": "'), text("user_id"), F.lit('"}'))
    rows = table(spark, sf_dir, "events").select("event_id", made.alias("made"))
    return rows.select("event_id", documents.canonical("made").alias("document"), documents.digest("made").alias("digest"))


@query(
    """
WITH r AS (SELECT doc_id, doc_id // 50 AS batch, CASE WHEN doc_id % 97 = 0 THEN 23 + doc_id % 4 ELSE doc_id % 5 END AS depth FROM documents),
b AS (SELECT batch, count(*) AS n, bool_or(depth > 24) AS bad FROM r GROUP BY batch)
SELECT doc_id, CAST(depth AS INTEGER) AS depth, CASE WHEN bad THEN 'record' WHEN n > 100 THEN 'count' END AS refused FROM r JOIN b USING (batch)"""
)
def snk_01_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with a record that nests too deep is refused whole."""
    deep = F.when(F.col("doc_id") % 97 == 0, 23 + F.col("doc_id") % 4).otherwise(F.col("doc_id") % 5).cast("int")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 50").alias("batch"), "source", deep.alias("deep"))
    made = F.concat(F.expr("repeat('[', deep)"), F.to_json(F.array("source")), F.expr("repeat(']', deep)"))
    # The innermost array is the source's, which counts for one.
    rows = rows.withColumn("deep", F.greatest(F.col("deep") - 1, F.lit(0))).withColumn("payload", F.when(deep == 0, F.lit("[ ]")).otherwise(made))
    judged = judged_batches(rows, "batch", documents.too_deep("payload"), F.octet_length("payload"))
    return judged.select("doc_id", documents.depth("payload").alias("depth"), "refused")


@query(
    """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS person, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS f, CASE WHEN o_orderkey % 40 <> 0 THEN o_orderdate + INTERVAL 30 DAY END AS t FROM orders)
SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM o a JOIN o b ON b.o_custkey = a.o_custkey AND a.o_orderkey < b.o_orderkey AND b.person <> a.person
 AND (b.t IS NULL OR a.f IS NULL OR b.t > a.f) AND (a.t IS NULL OR b.f IS NULL OR b.f < a.t)"""
)
def join_07_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of times of ownership of an account (customer) by different persons (priorities) that conflict."""
    start = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate"))
    end = F.when(F.col("o_orderkey") % 40 != 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", start.alias("f"), end.alias("t"))
    return intervals.meeting(orders, "o_custkey", "o_orderpriority", "f", "t", "o_orderkey")


INSTANTS = ("1993-03-01", "1995-06-15", "1997-12-31")


@query(
    f"""
WITH RECURSIVE e AS (SELECT 'c' || o_custkey AS account, 'p' || (o_orderkey % 997) AS person, o_orderdate AS f, CASE WHEN o_orderkey % 300 <> 0 THEN o_orderdate + INTERVAL 40 DAY END AS t,
 CASE WHEN o_orderkey % 11 = 0 THEN 'revoked' WHEN o_orderkey % 7 = 0 THEN 'candidate' ELSE 'confirmed' END AS status, o_orderkey % 13 = 0 AS hidden FROM orders),
i AS (SELECT unnest([{", ".join(f"TIMESTAMP '{d}'" for d in INSTANTS)}]) AS inst),
v AS (SELECT DISTINCT inst, account, person FROM e, i WHERE status = 'confirmed' AND NOT hidden AND f <= inst AND (t IS NULL OR inst < t)),
n AS (SELECT DISTINCT a.inst, a.account AS x, b.account AS y FROM v a JOIN v b ON a.inst = b.inst AND a.person = b.person),
r AS (SELECT inst, x, y FROM n UNION SELECT r.inst, r.x, n.y FROM r JOIN n ON n.inst = r.inst AND n.x = r.y)
SELECT inst AS "at", x AS account, min(y) AS person_group FROM r GROUP BY inst, x"""
)
def knw_13_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which accounts (customers) are one person at some instants, by confirmed links that hold then."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    status = F.when(key % 11 == 0, "revoked").when(key % 7 == 0, "candidate").otherwise("confirmed")
    links = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("account"), F.concat(F.lit("p"), (key % 997).cast("string")).alias("person"), day.alias("valid_from"),
        F.when(key % 300 != 0, day + F.expr("INTERVAL 40 DAYS")).alias("valid_to"), status.alias("status"), key.alias("record_id"),
    )
    asked = spark.sql(" UNION ALL ".join(f"SELECT TIMESTAMP '{d}' AS at" for d in INSTANTS))
    hidden = links.where("record_id % 13 = 0").select("record_id")
    return intervals.connected(links, asked, hidden)
