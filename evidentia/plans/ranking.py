"""Queries of windows, retrieval, graphs, knowledge, lifecycle and the journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import rules, text as tx
from ..operators import awareness, evidence, graph, journal, knowledge, retrieval, search
from ..session import spread, table
from .registry import query
from .scans import BM25_SQL, bm25_sql, bm25_top

_GOLD = "gold AS (SELECT b.item_id, d.doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text))"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id): documents that hold a benchmark item word for word."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return retrieval.holding(table(spark, sf_dir, "documents"), items)


def met(docs: DataFrame, pool: DataFrame) -> DataFrame:
    """The documents that a pool names."""
    return docs.join(pool.select("doc_id").distinct(), "doc_id", "left_semi")


@query(
    BM25_SQL
    + f""", {_GOLD},
size AS (SELECT item_id, count(*) AS n_gold FROM gold GROUP BY 1),
hit AS (SELECT r.item_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM ranked r JOIN gold g USING (item_id, doc_id) WHERE rank <= 10 GROUP BY 1),
ideal AS (SELECT item_id, n_gold, list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM size)
SELECT count(*) AS n_queries, round(avg(coalesce(hits, 0) / n_gold), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg
FROM ideal LEFT JOIN hit USING (item_id)"""
)
def agg_12_ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.quality(bm25_top(spark, sf_dir, 10), gold(spark, sf_dir), 10)


_HALVES = "(SELECT item_id * 2 + h AS item_id, CASE h WHEN 0 THEN substr(text, 1, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END AS text FROM benchmark, (VALUES (0), (1)) v(h))"


@query(
    bm25_sql(queries=_HALVES)
    + """, pool AS (SELECT * FROM ranked WHERE rank <= 32),
f AS (SELECT item_id // 2 AS item_id, doc_id, sum(1.0 / (60 + rank)) AS score, count(*) AS n_channels FROM pool GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f)
SELECT item_id, doc_id, round(score, 6) AS score, n_channels, rank FROM o WHERE rank <= 10"""
)
def agg_13_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants of each query (the halves of the passage), fused by rank."""
    items = table(spark, sf_dir, "benchmark")
    half = F.expr("cast(length(text) div 2 as int)")
    both = items.select((F.col("item_id") * 2).alias("query_id"), F.substring("text", F.lit(1), half).alias("text")).union(items.select(F.col("item_id") * 2 + 1, F.expr("substring(text, cast(length(text) div 2 + 1 as int))")))
    pool = retrieval.bm25(table(spark, sf_dir, "documents"), both, retrieval.POOLS["fast"])
    sightings = pool.select(F.expr("query_id div 2").alias("query_id"), F.col("doc_id").alias("id"), (F.col("query_id") % 2).alias("channel"), "rank")
    ranked = retrieval.top(retrieval.fused(sightings), "query_id", F.round("score", 9), "id", 10)
    return ranked.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.size("channels").cast("long").alias("n_channels"), F.col("rank").cast("long").alias("rank"))


@query(
    BM25_SQL
    + r"""SELECT item_id, doc_id, rank, len(list_intersect(dt, qt)) > 0 AS accepted FROM ranked JOIN (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS dt FROM documents) USING (doc_id)
JOIN (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), lambda t: NOT regexp_full_match(t, '\p{Nd}+') AND NOT list_contains(string_split('"""
    + " ".join(tx.STOP_WORDS)
    + """', ' '), t)) AS qt FROM benchmark) USING (item_id) WHERE rank <= 30"""
)
def flt_13_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = bm25_top(spark, sf_dir, 30)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.content_terms("text").alias("qt"))
    held = met(table(spark, sf_dir, "documents"), pool).select("doc_id", tx.content_terms("text").alias("dt"))
    both = pool.join(held, "doc_id").join(asked, "query_id")
    gate = rules.accepted(F.size(F.array_intersect("qt", "dt")), F.lit(None).cast("double"))
    return both.select(F.col("query_id").alias("item_id"), "doc_id", F.col("rank").cast("long").alias("rank"), gate.alias("accepted"))


@query(
    BM25_SQL
    + """SELECT item_id, doc_id, rank FROM ranked JOIN documents USING (doc_id) WHERE rank <= 20 AND source IN ('src0', 'src1', 'src2', 'src3', 'src4')"""
)
def win_01_rank_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks are those of the raw list: the filter comes after, and leaves gaps."""
    allowed = table(spark, sf_dir, "documents").where(F.col("source").isin("src0", "src1", "src2", "src3", "src4")).select("doc_id")
    return bm25_top(spark, sf_dir, 20).join(allowed, "doc_id", "left_semi").select(F.col("query_id").alias("item_id"), "doc_id", F.col("rank").cast("long").alias("rank"))


@query(
    r"""
WITH c AS (SELECT doc_id, start, substr(text, CAST(start AS INTEGER) + 1, 200) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 200)) AS start FROM documents WHERE length(text) > 0)),
s AS (SELECT *, len(list_distinct(regexp_extract_all(lower(piece), '[\p{L}\p{N}]+'))) AS n FROM c)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, start) AS r FROM s) WHERE r = 1"""
)
def win_02_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest stretch of each document; only its place and count are shuffled."""
    pieces = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(tx.spans("text", 200, 200)).alias("s"))
    counted = pieces.select("doc_id", F.col("s.start").alias("start"), F.size(F.array_distinct(tx.tokens("s.piece"))).alias("n"))
    return evidence.latest(counted, ["doc_id"], F.struct("n", -F.col("start"))).select("doc_id", "start", "n")


@query(
    """
WITH l AS (SELECT DISTINCT l_partkey AS entity, l_orderkey AS record FROM lineitem),
o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY record ORDER BY entity) <= 6), i AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY entity ORDER BY record DESC) <= 16)
SELECT DISTINCT o.record, i.record AS met FROM o JOIN i USING (entity) WHERE i.record <> o.record"""
)
def win_03_degree_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each record meets over its first six entities, each with its sixteen newest records."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("record"))
    return graph.expanded(links)


@query(
    BM25_SQL
    + """, w AS (SELECT *, min(CASE WHEN rank <= 24 THEN -dl END) OVER (PARTITION BY item_id) AS lo, max(CASE WHEN rank <= 24 THEN -dl END) OVER (PARTITION BY item_id) AS hi
 FROM (SELECT r.*, CAST(length(d.text) AS DOUBLE) AS dl FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 32))
SELECT item_id, doc_id, rank, round(CASE WHEN rank > 24 THEN score WHEN hi > lo THEN 1 + (-dl - lo) / (hi - lo) ELSE 1 END, 6) AS score FROM w"""
)
def win_04_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-ranking by a pluggable score (here: shorter texts first), scaled into a band above fusion scores."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", (-F.length("text").cast("double")).alias("logit"))
    pool = bm25_top(spark, sf_dir, 32).join(sizes, "doc_id")
    return retrieval.rescaled(pool, "logit").select(F.col("query_id").alias("item_id"), "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    BM25_SQL
    + """, u AS (SELECT r.item_id, r.doc_id, r.rank, length(d.text) AS n, coalesce(sum(length(d.text)) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
 FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 30)
SELECT item_id, doc_id, rank, CAST(least(n, 16000 - used) AS BIGINT) AS taken FROM u WHERE used < 16000"""
)
def win_05_budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    pool = bm25_top(spark, sf_dir, 30).join(sizes, "doc_id")
    return retrieval.budgeted(pool, "query_id", [F.col("rank")], F.col("n"), 16_000).select(F.col("query_id").alias("item_id"), "doc_id", F.col("rank").cast("long").alias("rank"), "taken")


@query(
    """
SELECT doc_id, round, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS round FROM documents)
ORDER BY round, source, doc_id LIMIT 30"""
)
def win_06_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"))
    return retrieval.interleaved(rows, "source", [F.desc("n"), F.col("doc_id")], "doc_id", 30).select("doc_id", F.col("round").cast("long").alias("round"), "source")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) - 1 AS ordinal FROM conversations")
def win_11_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.row_number().over(by) - 1).cast("long").alias("ordinal"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS transition_version FROM events")
def win_12_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(by).cast("long").alias("transition_version"))


@query(
    """
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 7 AS root, l_partkey AS child FROM lineitem WHERE l_linenumber = 1),
t AS (SELECT p_partkey AS child, p_partkey // 10 AS parent FROM part WHERE p_partkey >= 10),
r(id) AS (SELECT p_partkey FROM part WHERE p_partkey IN (3, 7) UNION SELECT t.child FROM t JOIN r ON t.parent = r.id)
SELECT id FROM r"""
)
def rec_01_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey")
    edges = parts.where("p_partkey >= 10").select(F.expr("p_partkey div 10").alias("parent"), F.col("p_partkey").alias("child"))
    return graph.closure(edges, parts.where("p_partkey in (3, 7)").select(F.col("p_partkey").alias("id")))


_EDGES = """
WITH d AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
e AS (SELECT a, b FROM d UNION SELECT b, a FROM d)"""


@query(
    _EDGES
    + """, h0 AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS id FROM region),
h1 AS (SELECT DISTINCT seed, e.b AS id FROM h0 JOIN e ON e.a = h0.id),
h2 AS (SELECT DISTINCT seed, e.b AS id FROM h1 JOIN e ON e.a = h1.id)
SELECT seed, id, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY seed, id"""
)
def rec_03_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), c)
    edges = table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("a"), name("n", "n_nationkey").alias("b"))
    edges = edges.union(table(spark, sf_dir, "supplier").select(name("n", "s_nationkey"), name("s", "s_suppkey")))
    edges = edges.union(table(spark, sf_dir, "customer").select(name("n", "c_nationkey"), name("c", "c_custkey")))
    return graph.hops(edges, table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("id")), 2)


@query(
    """
WITH l AS (SELECT DISTINCT l_orderkey AS record, l_partkey AS entity FROM lineitem),
o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY record ORDER BY entity) <= 6),
i AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY entity ORDER BY record DESC) <= 16),
s AS (SELECT o_orderkey AS record FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6),
v1 AS (SELECT record FROM s UNION SELECT i.record FROM i WHERE entity IN (SELECT entity FROM o WHERE record IN (SELECT record FROM s))),
v AS (SELECT record FROM v1 UNION SELECT i.record FROM i WHERE entity IN (SELECT entity FROM o WHERE record IN (SELECT record FROM v1))),
own AS (SELECT *, count(*) OVER (PARTITION BY record) AS n FROM o WHERE record IN (SELECT record FROM v)),
back AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM i WHERE record IN (SELECT record FROM v) AND entity IN (SELECT entity FROM own)),
e1 AS (SELECT entity, sum(1.0 / 6 / n) AS m FROM own JOIN s USING (record) GROUP BY 1),
r1 AS (SELECT record, sum(m / n) AS g FROM e1 JOIN back USING (entity) GROUP BY 1),
m1 AS (SELECT v.record, 0.4 * CASE WHEN s.record IS NULL THEN 0 ELSE 1.0 / 6 END + 0.6 * coalesce(g, 0) AS m FROM v LEFT JOIN s USING (record) LEFT JOIN r1 USING (record)),
e2 AS (SELECT entity, sum(m / n) AS m FROM own JOIN m1 USING (record) GROUP BY 1),
r2 AS (SELECT record, sum(m / n) AS g FROM e2 JOIN back USING (entity) GROUP BY 1)
SELECT v.record, round(CAST(0.6 * coalesce(g, 0) AS DOUBLE), 9) AS score FROM v LEFT JOIN r2 USING (record) WHERE v.record NOT IN (SELECT record FROM s) AND 0.6 * coalesce(g, 0) > 1e-9"""
)
def rec_05_ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_partkey").alias("entity")).distinct()
    seeds = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(6).select(F.lit(0).alias("query_id"), F.col("o_orderkey").alias("record"), F.lit(1.0).alias("weight"))
    return graph.diffusion(links, seeds).select("record", F.round("score", 9).alias("score"))


_SIM = """
, vq AS (SELECT item_id, e.embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings e ON e.vec_id = item_id),
vs AS (SELECT vq.item_id, e.vec_id AS doc_id, list_cosine_similarity(vq.v, e.embedding::DOUBLE[]) AS sim FROM vq, embeddings e),
vr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, doc_id) AS rank FROM vs),
pool AS (SELECT item_id, doc_id, 1.0 / (60 + rank) AS share, NULL::DOUBLE AS sim FROM ranked WHERE rank <= 32 UNION ALL SELECT item_id, doc_id, 1.0 / (60 + rank), sim FROM vr WHERE rank <= 32),
fused AS (SELECT item_id, doc_id, sum(share) AS score, max(sim) AS sim FROM pool GROUP BY 1, 2),
hyd AS (SELECT f.*, d.text, TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 700 AS INTEGER)) AS happened FROM fused f JOIN documents d USING (doc_id)
  WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rec AS (SELECT *, score * (1 + pow(0.5, greatest(0, epoch(TIMESTAMP '2026-01-01') - epoch(happened)) / 86400.0 / 365)) AS final FROM hyd)
"""


@query(
    BM25_SQL
    + _SIM
    + r""", gated AS (SELECT rec.*, row_number() OVER (PARTITION BY item_id ORDER BY round(final, 9) DESC, doc_id) AS place FROM rec JOIN (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), lambda t: NOT regexp_full_match(t, '\p{Nd}+') AND NOT list_contains(string_split('"""
    + " ".join(tx.STOP_WORDS)
    + r"""', ' '), t)) AS qt FROM benchmark) USING (item_id)
 WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), qt)) > 0 OR sim >= 0.5)
SELECT item_id, doc_id, round(final, 6) AS score, place FROM gated WHERE place <= 8"""
)
def ret_01_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector channels, fused by rank; live documents only; recency; the gate; the first eight.

    vec_id stands for doc_id, and an item's vector is that of its number; a document's date follows from its id.
    """
    best = search.hybrid(dated(spark, sf_dir), asked_texts(spark, sf_dir), now(), *asked_vectors(spark, sf_dir), hidden=toxic(spark, sf_dir))
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("place"))


def now() -> Column:
    return F.expr("TIMESTAMP '2026-01-01'")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampadd(DAY, cast(doc_id % 700 as int), TIMESTAMP '2024-01-01')")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", at.alias("at"))


def asked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("variant"), "text")


def asked_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(id, vector) of all, and (query_id, vector) of the items."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = table(spark, sf_dir, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), asked


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))


@query("SELECT event_id, round(value * (1 + pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2030-01-01') - epoch_us(ts)) / 86400000000.0) / 365)), 6) AS score FROM events")
def ret_04_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(rules.recency(F.col("value"), F.col("ts"), F.expr("TIMESTAMP '2030-01-01'")), 6).alias("score"))


@query(
    """
WITH b AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 25 DAY FROM events) AND ts + INTERVAL 20 DAY > (SELECT min(ts) + INTERVAL 25 DAY FROM events)),
c AS (SELECT *, (k % 2 = 0)::INT AS n_context FROM b WHERE k % 2 = 1 OR k % 4 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (k = 1)::INT DESC, n_context DESC, ts DESC, event_id) AS place,
 min(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id, event_type) <> max(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id, event_type) AS conflict FROM c)
SELECT user_id, event_type, event_id, conflict FROM r WHERE place = 1"""
)
def knw_02_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading belief of each subject and predicate at an instant and in a context: explicit first, then the richest
    stored context, then the newest. A belief holds if all that its context says is so in the given one.
    """
    events = table(spark, sf_dir, "events")
    at = F.lit(events.agg(F.min("ts") + F.expr("INTERVAL 25 DAYS")).first()[0])
    k = F.get_json_object("props", "$.k").cast("long")
    held = events.where(rules.valid_at(F.col("ts"), F.col("ts") + F.expr("INTERVAL 20 DAYS"), at)).select("user_id", "event_type", "event_id", "ts", k.alias("k"), F.floor("value").alias("v"))
    stored = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("fourth"), (F.col("k") % 4).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    fit = held.withColumn("context", stored).where(F.col("k").isNotNull() & rules.context_holds(F.col("context"), F.create_map(F.lit("fourth"), F.lit("0"))))
    lead = F.max_by("event_id", F.struct((F.col("k") == 1).cast("int"), F.size("context"), "ts", -F.col("event_id")))
    return fit.groupBy("user_id", "event_type").agg(lead.alias("event_id"), (F.min("v") != F.max("v")).alias("conflict"))


@query(
    """
SELECT event_id, round(CASE event_id % 12 WHEN 0 THEN value * 0.001 WHEN 1 THEN value * 0.45359237 WHEN 2 THEN value WHEN 3 THEN (value - 32) * 5 / 9 WHEN 4 THEN value WHEN 5 THEN value WHEN 6 THEN value WHEN 7 THEN value WHEN 8 THEN value WHEN 9 THEN value * 0.001 END, 6) AS canonical,
 least(3600, 30 * CAST(pow(2, event_id % 12) AS BIGINT)) AS wait FROM events"""
)
def knw_06_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of all metrics in canonical units; the last two are of units that are not registered."""
    pairs = [("mass", "g"), ("weight", "lb"), ("body_mass", "kg"), ("temperature", "F"), ("body_temperature", "C"), ("heart_rate", "bpm"), ("hrv", "ms"), ("systolic_bp", "mmHg"), ("diastolic_bp", "mmHg"), ("body_mass", "g"), ("mass", "stone"), ("hrv", "kg")]
    given = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(u).alias("unit")) for m, u in pairs))
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.get(given, (F.col("event_id") % 12).cast("int")).alias("g"))
    return rows.select("event_id", F.round(rules.canonical(F.col("g.metric"), F.col("g.unit"), F.col("value")), 6).alias("canonical"), rules.backoff(F.col("event_id") % 12).alias("wait"))


@query(
    """
WITH s AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'completed' END AS state FROM orders),
l AS (SELECT *, lag(state) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM s)
SELECT o_orderkey, before IS NULL OR coalesce((before = 'open' AND state IN ('in_progress', 'blocked', 'cancelled')) OR (before = 'in_progress' AND state IN ('blocked', 'completed', 'cancelled')), false) AS legal FROM l"""
)
def knw_09_task_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed")
    log = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", state.alias("state"))
    return knowledge.illegal_steps(log, "o_custkey", [F.col("o_orderkey")], "state", knowledge.TASK_STEPS).select("o_orderkey", "legal")


@query(
    """
WITH s AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'completed' END AS state, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT id, before IS NULL OR before = 'F' AS ready, before IS NULL OR before = 'F' OR state = 'open' AS allowed FROM s"""
)
def knw_09_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that need the one before of their owner: work on them may begin or end when that is completed."""
    state = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed")
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", state.alias("state"))
    before = F.lag("id").over(Window.partitionBy("o_custkey").orderBy("id"))
    needs = tasks.select("id", before.alias("needs")).where("needs is not null")
    return knowledge.with_dependencies(tasks.select("id", "state"), needs, tasks).select("id", "ready", "allowed")


@query(
    """
WITH c AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'ack' ELSE 'retry' END AS command FROM events),
g AS (SELECT user_id, count(*) FILTER (WHERE command = 'claim') AS attempts, min(event_id) FILTER (WHERE command = 'claim') AS f, max(event_id) FILTER (WHERE command = 'claim') AS c, max(event_id) FILTER (WHERE command = 'ack') AS a, max(event_id) FILTER (WHERE command = 'retry') AS r FROM c GROUP BY 1)
SELECT user_id, attempts, CASE WHEN a > f THEN 'delivered' WHEN attempts >= 3 THEN 'quarantined' WHEN c IS NOT NULL AND (r IS NULL OR c > r) THEN 'leased' ELSE 'pending' END AS state FROM g"""
)
def knw_09_event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "ack").otherwise("retry")
    log = table(spark, sf_dir, "events").select("user_id", "event_id", command.alias("command"))
    return knowledge.event_states(log, "user_id", "event_id").select("user_id", "attempts", "state")


@query(
    """
WITH RECURSIVE t AS (SELECT doc_id AS child, doc_id // 4 AS parent FROM documents WHERE doc_id >= 4),
r(id) AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT t.child FROM t JOIN r ON t.parent = r.id)
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT id FROM r)"""
)
def lif_01_forget_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when forgotten documents take all that was derived from them along."""
    docs = table(spark, sf_dir, "documents")
    edges = docs.where("doc_id >= 4").select(F.expr("doc_id div 4").alias("parent"), F.col("doc_id").alias("child"))
    gone = graph.closure(edges, table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))
    return evidence.live(docs, gone.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "source")


@query(
    """
WITH RECURSIVE t AS (SELECT doc_id AS child, doc_id // 4 AS parent FROM documents WHERE doc_id >= 4),
h(id) AS (SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT t.child FROM t JOIN h ON t.parent = h.id),
k(id) AS (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT t.child FROM t JOIN k ON t.parent = k.id)
SELECT id AS doc_id FROM h EXCEPT SELECT id FROM k"""
)
def lif_03_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden by a superseded document's closure, but for what its replacements' closure keeps."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    edges = docs.where("doc_id >= 4").select(F.expr("doc_id div 4").alias("parent"), F.col("doc_id").alias("child"))
    hidden = graph.closure(edges, labels.where("quality = 0").select(F.col("doc_id").alias("id")))
    kept = graph.closure(edges, labels.where("quality = 1").select(F.col("doc_id").alias("id")))
    return hidden.subtract(kept).withColumnRenamed("id", "doc_id")


@query(
    """
WITH l AS (SELECT conv_id, turn, sha256(role) AS d, length(text) % 3 AS m FROM conversations),
k AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN d <> lag(d) OVER w THEN 'content_updated' WHEN m <> lag(m) OVER w THEN 'metadata_updated' ELSE 'unchanged' END AS kind FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, kind, CAST(sum(CASE WHEN kind <> 'unchanged' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS transition_version,
 'evt_' || substr(sha256('["' || conv_id || '","' || turn || '","' || kind || '"]'), 1, 32) AS event_id FROM k"""
)
def str_02_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.col("role").cast("binary"), 256).alias("d"), (F.length("text") % 3).alias("m"))
    told = journal.event_ids(journal.transitions(log, "conv_id", "turn", "d", "m"), "conv_id", "turn", "kind")
    return told.select("conv_id", "turn", "kind", "transition_version", "event_id")


SWEEP_SQL = """
WITH RECURSIVE e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'next_turn' ELSE 'background' END AS decision, strftime(ts, '%Y-%m-%d 00:00:00') AS grp, event_id,
 CAST(greatest(500, length(props) + 150 * least(user_id, 8)) AS BIGINT) AS chars, {until} AS until FROM events WHERE event_type <> 'view'),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, until ORDER BY first, decision, grp, event_id) AS rn FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, until, decision, grp) AS first FROM e)),
p AS (SELECT user_id, until, rn, decision, grp, event_id, chars, 0 AS part, chars AS used FROM o WHERE rn = 1
 UNION ALL SELECT o.user_id, o.until, o.rn, o.decision, o.grp, o.event_id, o.chars,
  CASE WHEN o.decision = p.decision AND o.grp = p.grp AND p.used + o.chars <= 4000 THEN p.part ELSE p.part + 1 END,
  CASE WHEN o.decision = p.decision AND o.grp = p.grp AND p.used + o.chars <= 4000 THEN p.used + o.chars ELSE o.chars END
 FROM p JOIN o ON o.user_id = p.user_id AND o.until = p.until AND o.rn = p.rn + 1),
t AS (SELECT user_id, until, part, any_value(decision) AS decision, sum(chars) AS size FROM p GROUP BY 1, 2, 3),
b AS (SELECT user_id, until, part, decision, 0 AS batch, 1 AS held, size AS used FROM t WHERE part = 0
 UNION ALL SELECT t.user_id, t.until, t.part, t.decision,
  CASE WHEN t.decision = b.decision AND b.held < 8 AND b.used + t.size <= 4000 THEN b.batch ELSE b.batch + 1 END,
  CASE WHEN t.decision = b.decision AND b.held < 8 AND b.used + t.size <= 4000 THEN b.held + 1 ELSE 1 END,
  CASE WHEN t.decision = b.decision AND b.held < 8 AND b.used + t.size <= 4000 THEN b.used + t.size ELSE t.size END
 FROM b JOIN t ON t.user_id = b.user_id AND t.until = b.until AND t.part = b.part + 1)
"""


def sweep_events(events: DataFrame) -> DataFrame:
    """Events as the journal's: users are consumers, errors call for the next turn, days are groups."""
    decision = F.when(F.col("event_type") == "error", "next_turn").otherwise("background")
    told = events.where("event_type != 'view'").select("user_id", decision.alias("decision"), F.date_trunc("day", "ts").cast("string").alias("grp"), "event_id", awareness.event_chars("props", "user_id").cast("long").alias("chars"), "ts")
    return told


@query(SWEEP_SQL.format(until=0) + "SELECT user_id, p.decision, grp, event_id, chars, CAST(batch AS BIGINT) AS batch FROM p JOIN b USING (user_id, until, part)")
def str_04_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen batches of each consumer (user): groups in order of their first event, cut on the budget and put together while
    the decision stays the same.
    """
    told = sweep_events(table(spark, sf_dir, "events")).drop("ts")
    return awareness.swept(told, "user_id", ["decision"], "grp", "event_id", "chars", awareness.PACKET_GROUPS, awareness.PACKET_CHARS)


@query(
    """
SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN 'pending' ELSE 'ready' END AS semantic, CASE WHEN l.doc_id IS NULL THEN 'disabled' WHEN l.quality = 1 THEN 'ready' ELSE 'failed' END AS review
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def str_09_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("ready").alias("semantic"))
    reviews = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("review"))
    both = docs.join(vectors, "doc_id", "left").join(reviews, "doc_id", "left")
    return both.select("doc_id", F.coalesce("semantic", F.lit("pending")).alias("semantic"), F.coalesce("review", F.lit("disabled")).alias("review"))


@query(
    """
WITH o AS (SELECT event_type, user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events),
m AS (SELECT *, max(v) OVER (PARTITION BY event_type, user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM o)
SELECT event_type, user_id, max(v) AS v, max_by(event_id, v * 100000000 + event_id) AS event_id, count(*) FILTER (WHERE v < best) AS history_only FROM m GROUP BY 1, 2"""
)
def snk_05_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["event_type", "user_id"]
    operations = table(spark, sf_dir, "events").select(*by, "event_id", F.get_json_object("props", "$.k").cast("long").alias("v"))
    late = knowledge.history_only(operations, by, "v", "event_id").groupBy(*by).agg(F.count(F.when(F.col("late"), 1)).alias("history_only"))
    return knowledge.current_heads(operations, by, "v", "event_id").join(late, by)


@query(
    """
WITH o AS (SELECT user_id, event_id AS seq, ['upsert', 'metadata_update', 'remove', 'restore', 'skip'][1 + event_id % 5] AS action, ['incremental', 'reconcile', 'backfill'][1 + event_id % 3] AS role,
 CASE WHEN event_id % 7 > 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS version FROM events WHERE event_id % 5 <> 4),
e AS (SELECT *, action IN ('upsert', 'metadata_update') AS edit, CASE WHEN version IS NULL THEN 3 - event_rank ELSE 0 END AS rank FROM (SELECT *, seq % 3 AS event_rank FROM o)),
h AS (SELECT user_id, seq AS head_seq, version FROM e WHERE edit QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coalesce(version, -1) DESC, rank DESC, seq DESC) = 1),
g AS (SELECT user_id, max(seq) FILTER (WHERE action = 'remove') AS removed, max(seq) FILTER (WHERE action = 'restore' OR (edit AND role <> 'backfill')) AS revived FROM e GROUP BY user_id)
SELECT g.user_id, CASE WHEN removed IS NULL OR coalesce(revived > removed, false) THEN 'live' ELSE 'removed' END AS state, coalesce(h.version, -1) AS version, coalesce(greatest(h.head_seq, removed, CASE WHEN removed IS NOT NULL THEN revived END), -1) AS moved_at FROM g LEFT JOIN h USING (user_id)"""
)
def snk_05_item_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts, metadata updates, removals, restorations and skips of items (users), by streams of three roles."""
    one = lambda names: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int"))
    version = F.when(F.col("event_id") % 7 > 1, F.get_json_object("props", "$.k").cast("long"))
    operations = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), one(["upsert", "metadata_update", "remove", "restore", "skip"]).alias("action"), one(knowledge.ROLES).alias("role"), version.alias("version"))
    states = knowledge.item_states(operations, ["user_id"])
    return states.select("user_id", "state", F.coalesce("version", F.lit(-1).cast("long")).alias("version"), F.coalesce("moved_at", F.lit(-1).cast("long")).alias("moved_at"))
