"""Queries of records made of other records: parts of files, measurements, derived and old forms, versions and JSON walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules
from ..operators import records
from ..session import table
from .registry import query


@query(
    """
SELECT event_id, ['weight', 'body_temperature', 'heart_rate'][1 + event_id % 3] AS metric, round(CASE event_id % 3 WHEN 0 THEN value * 0.45359237 WHEN 1 THEN (value - 32) * 5 / 9 ELSE value END, 6) AS value,
 ['kg', 'C', 'bpm'][1 + event_id % 3] AS unit, ts AS measured_at FROM events WHERE value IS NOT NULL AND isfinite(value)"""
)
def src_12_typed_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported measurements in the typed store's form: canonical units, finite values."""
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "events").where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    value = rules.canonical(pick("weight", "body_temperature", "heart_rate"), pick("lb", "F", "bpm"), F.col("value"))
    return rows.select("event_id", pick("weight", "body_temperature", "heart_rate").alias("metric"), F.round(value, 6).alias("value"), pick("kg", "C", "bpm").alias("unit"), F.col("ts").alias("measured_at"))


@query(
    """
WITH f AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, CAST(part AS INTEGER) AS part, substr(text, CAST(part * 60000 + 1 AS INTEGER), 60000) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 60000.0) AS BIGINT), 1))) AS part FROM f)),
o AS (SELECT doc_id, part, sha256(piece) AS d FROM p WHERE doc_id % 4 <> 0), n AS (SELECT doc_id, part, sha256(CASE WHEN doc_id % 5 = 0 THEN piece || '!' ELSE piece END) AS d FROM p WHERE doc_id % 7 <> 0),
c AS (SELECT d, min(doc_id) AS doc FROM o GROUP BY d)
SELECT doc_id, part, CASE WHEN o.d IS NULL THEN 'new' WHEN n.d IS NULL THEN 'removed' WHEN o.d = n.d THEN 'unchanged' ELSE 'changed' END AS status, CASE WHEN o.d IS NULL THEN CAST(c.doc AS VARCHAR) END AS copy_of
FROM o FULL JOIN n USING (doc_id, part) LEFT JOIN c ON c.d = n.d"""
)
def src_22_file_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of files, by parts of 60,000 characters: what is new, changed or removed, and what is a copy."""
    parts = records.parts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "part", "piece", "digest")
    old = parts.where("doc_id % 4 != 0")
    new = parts.where("doc_id % 7 != 0").withColumn("digest", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("piece", F.lit("!")), 256)).otherwise(F.col("digest")))
    found = records.copies(old, new, ["doc_id", "part"], "digest")
    return found.select("doc_id", "part", "status", F.col("copy_of.doc_id").cast("string").alias("copy_of"))


@query(
    """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, CASE event_type WHEN 'error' THEN 'clear' WHEN 'view' THEN 'remove' WHEN 'click' THEN 'replace' ELSE 'add' END AS action, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS entry FROM events),
l AS (SELECT *, lead(version) OVER (PARTITION BY user_id, entry ORDER BY version) AS later, min(CASE WHEN action = 'clear' THEN version END) OVER (PARTITION BY user_id ORDER BY version ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cleared FROM e)
SELECT user_id, event_id, entry, version, coalesce(least(later, cleared), -1) AS retired_version FROM l WHERE action IN ('add', 'replace')"""
)
def snk_13_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of curated entries as versions with their ends: none is ever changed in place."""
    action = F.when(F.col("event_type") == "error", "clear").when(F.col("event_type") == "view", "remove").when(F.col("event_type") == "click", "replace").otherwise("add")
    edits = table(spark, sf_dir, "events").select("user_id", "event_id", action.alias("action"), (F.get_json_object("props", "$.k").cast("long") % 4).alias("entry"))
    return records.versions(edits, "user_id", "entry", "event_id").select("user_id", "event_id", "entry", F.col("version").cast("long").alias("version"), F.coalesce(F.col("retired_version").cast("long"), F.lit(-1)).alias("retired_version"))


@query(
    """
SELECT '1.0' AS schema_version, 'page' AS source, 'attachment-text:' || sha256(url) AS source_id, '1' AS revision, 'attachment_text' AS kind, CAST(NULL AS VARCHAR) AS occurred_at, '2024-01-01T00:00:00Z' AS observed_at,
 html AS text, 'blob://' || sha256(url) AS source_locator, 'derived' AS origin, ['rec_' || page_id] AS parent_record_ids FROM pages"""
)
def snk_14_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.lit("page").alias("source"), F.lit(None).cast("string").alias("occurred_at"))
    blob = F.sha2(F.col("url").cast("binary"), 256)
    return records.derived(parents, F.concat(F.lit("rec_"), "page_id"), blob, F.col("html"), F.lit("2024-01-01T00:00:00Z"))


@query(
    """
SELECT '1.0' AS schema_version, source, CAST(doc_id AS VARCHAR) AS source_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'r' || doc_id END, '1') AS revision, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'episode') AS kind, CAST(NULL AS VARCHAR) AS occurred_at,
 '2024-01-01T00:00:00Z' AS observed_at, text, CASE WHEN source IN ('src1', 'src2') THEN 'assistant' ELSE 'source' END AS origin FROM documents"""
)
def snk_15_adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("source_id"), "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("r"), "doc_id")).alias("revision"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("kind"), F.lit(None).cast("string").alias("occurred_at"))
    return records.adapted(old, ["src1", "src2"], F.lit("2024-01-01T00:00:00Z"))


@query(
    """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN list_sort(list_distinct(['r' || conv_id, 'e' || turn, 'p' || (conv_id % 10), 'q'])) WHEN turn % 3 = 1 THEN ['r' || conv_id] ELSE [] END AS record_ids FROM conversations"""
)
def rec_07_json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record ids that nested JSON holds, at whatever depth."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    deep = F.to_json(F.struct(F.struct(F.concat(F.lit("r"), conv).alias("record_id"), F.array(F.struct(F.concat(F.lit("e"), turn).alias("id"))).alias("episodes")).alias("a"), F.array(F.struct(F.array(F.concat(F.lit("p"), (F.col("conv_id") % 10).cast("string")), F.lit("q")).alias("parent_record_ids"))).alias("b")))
    flat = F.to_json(F.struct(F.array(F.concat(F.lit("r"), conv)).alias("record_ids"), F.lit("x").alias("id")))
    payload = F.when(F.col("turn") % 3 == 0, deep).when(F.col("turn") % 3 == 1, flat).otherwise(F.lit("{broken"))
    return records.evidence_ids(table(spark, sf_dir, "conversations").select("conv_id", "turn", payload.alias("payload")), "payload").select("conv_id", "turn", "record_ids")


@query(
    """
WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 300)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, count(*) AS n_chunks, max(length(substr(text, CAST(start + 1 AS INTEGER), 400))) AS longest FROM c WHERE start = 0 OR start + 100 < length(text) GROUP BY doc_id"""
)
def fn_17_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 400 characters that overlap by 100."""
    from ..functions import text as tx

    chunks = table(spark, sf_dir, "documents").select("doc_id", tx.spans("text", 400, 300).alias("s")).where("s is not null")
    return chunks.select("doc_id", F.size("s").cast("long").alias("n_chunks"), F.array_max(F.transform("s", lambda s: F.length(s["piece"]))).cast("long").alias("longest"))


@query(
    """
WITH e AS (SELECT event_id AS edge, 'u' || user_id AS a, 'k' || CAST(json_extract(props, '$.k') AS BIGINT) AS b, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-05' END AS f, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-20' END AS t FROM events WHERE event_type = 'purchase'),
v AS (SELECT edge, a, b FROM e WHERE (f IS NULL OR f <= TIMESTAMP '2024-01-10') AND (t IS NULL OR TIMESTAMP '2024-01-10' < t)),
d AS (SELECT edge, a, b FROM v UNION ALL SELECT edge, b, a FROM v),
s AS (SELECT DISTINCT 'u' || user_id AS seed FROM events WHERE user_id % 10 = 0),
h1 AS (SELECT seed, edge, b AS node, 1 AS hop FROM s JOIN d ON a = seed),
h2 AS (SELECT x.seed, d.edge, 2 AS hop FROM (SELECT DISTINCT seed, node FROM h1) x JOIN d ON d.a = x.node),
m AS (SELECT seed, edge, min(hop) AS hop FROM (SELECT seed, edge, hop FROM h1 UNION ALL SELECT seed, edge, hop FROM h2) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, edge) AS n, count(*) OVER (PARTITION BY seed) > 200 AS truncated FROM m)
SELECT seed, edge, CAST(hop AS INTEGER) AS hop, truncated FROM r WHERE n <= 200"""
)
def rec_03_typed_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations valid at an instant within two hops of some entities, two hundred at most, and whether there are more."""
    from ..operators import graph

    key = F.col("event_id")
    edges = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(key.alias("edge"), F.concat(F.lit("u"), "user_id").alias("a"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("b"), F.when(key % 2 == 0, F.expr("TIMESTAMP '2024-01-05'")).alias("valid_from"), F.when(key % 3 == 0, F.expr("TIMESTAMP '2024-01-20'")).alias("valid_to"))
    seeds = table(spark, sf_dir, "events").where("user_id % 10 = 0").select(F.concat(F.lit("u"), "user_id").alias("id")).distinct()
    return graph.typed_hops(edges, seeds, 2, F.expr("TIMESTAMP '2024-01-10'"))
