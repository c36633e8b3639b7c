"""Queries of claims, summaries, filtered and graph-led search, beliefs and quotes.

Claims are the turns of conversations: their record is a document, their scope the speaker's turns of one kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules, text as tx
from ..operators import claims as cl, knowledge, recall, retrieval, search
from ..session import table
from .ranking import asked_texts, dated, now, toxic
from .registry import query
from .scans import bm25_sql, bm25_top

_DEAD = "(SELECT doc_id FROM labels WHERE toxic = 1)"
_AWAY = "(SELECT doc_id FROM labels WHERE quality = 0)"
_CLAIMS = f"""(SELECT id, record_id, text, turn, CASE WHEN later IS NOT NULL THEN 'superseded' WHEN record_id IN {_DEAD} THEN 'retracted' WHEN record_id IN {_AWAY} THEN 'retired' ELSE 'active' END AS status
 FROM (SELECT conv_id * 100 + turn AS id, conv_id * 5 + turn % 5 AS record_id, text, turn, lead(turn) OVER (PARTITION BY conv_id, role, turn % 4 ORDER BY turn) AS later FROM conversations))"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, record_id, text, turn, status), as the state of the records leaves them."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.col("conv_id") * 5 + F.col("turn") % 5).alias("record_id"), "conv_id", "role", (F.col("turn") % 4).alias("kind"), "turn", "text")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "record_id")
    stated = cl.statuses(rows, ["conv_id", "role", "kind"], "turn")
    return cl.repaired(stated, labels.where("toxic = 1"), labels.where("quality = 0")).select("id", "record_id", "text", "turn", "status")


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, source) of the records that are neither forgotten nor hidden."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").join(gone, "doc_id", "left_anti").select(F.col("doc_id").alias("record_id"), "source")


_LIVE = f"(SELECT doc_id FROM documents WHERE doc_id NOT IN {_DEAD} AND doc_id NOT IN {_AWAY})"


@query(
    bm25_sql(f"(SELECT id AS doc_id, text, status = 'active' AND record_id IN {_LIVE} AS eligible FROM {_CLAIMS})")
    + f"SELECT item_id, id, record_id, round(score, 6) AS score, rank FROM ranked r JOIN {_CLAIMS} c ON c.id = r.doc_id WHERE rank <= 10"
)
def src_04_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best active claims of each item, whose records are live and visible; counts are those of all claims."""
    every = claims(spark, sf_dir)
    marked = every.join(live(spark, sf_dir).select("record_id", F.lit(True).alias("ok")), "record_id", "left")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    only = cl.shown(F.col("status")) & F.coalesce("ok", F.lit(False))
    best = retrieval.bm25(marked, asked, 10, "id", only=only)
    named = every.select(F.col("id").alias("doc_id"), "record_id")
    return best.join(named, "doc_id").select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("id"), "record_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    bm25_sql("(SELECT d.doc_id, d.text, true AS eligible FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))")
    + "SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5"
)
def src_05_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search among accepted summaries: the documents that passed review stand for them."""
    passed = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    summaries = table(spark, sf_dir, "documents").join(passed, "doc_id", "left_semi").select("doc_id", "text")
    best = retrieval.bm25(summaries, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5)
    return best.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    bm25_sql()
    + f""", hit AS (SELECT item_id, doc_id AS record_id, rank FROM ranked WHERE rank <= 20),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY turn DESC, id) AS n FROM {_CLAIMS} WHERE status <> 'retracted') WHERE n <= 30),
p AS (SELECT item_id, record_id, id, row_number() OVER (PARTITION BY item_id ORDER BY rank, n) AS place FROM hit JOIN c USING (record_id))
SELECT item_id, record_id, id, place FROM p WHERE place <= 10"""
)
def join_03_attached_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims, with their history, of the records that a search found: thirty a record, ten in all."""
    hits = bm25_top(spark, sf_dir, 20).select("query_id", F.col("doc_id").alias("record_id"), "rank")
    held = cl.attached(hits, claims(spark, sf_dir), [F.desc("turn"), F.col("id")], 10, history=True)
    return held.select(F.col("query_id").alias("item_id"), "record_id", "id", F.col("place").cast("long").alias("place"))


@query(f"SELECT id, record_id, status FROM {_CLAIMS} WHERE status <> 'retracted'")
def flt_12_claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).where(cl.shown(F.col("status"), history=True)).select("id", "record_id", "status")


@query(f"SELECT record_id, count(*) AS n_claims, count(*) FILTER (WHERE status = 'active') AS n_active FROM {_CLAIMS} c JOIN documents d ON d.doc_id = c.record_id GROUP BY 1")
def join_02_claims_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with their records, counted for each before they are joined."""
    counts = claims(spark, sf_dir).groupBy("record_id").agg(F.count("*").alias("n_claims"), F.count(F.when(F.col("status") == "active", 1)).alias("n_active"))
    return counts.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id")), "record_id")


_FILTERED = """doc_id IN (SELECT doc_id FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') AND TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 700 AS INTEGER)) >= TIMESTAMP '2024-03-01') AND doc_id <> item_id * 3"""
_CONTENT = r"list_filter(list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')), lambda t: NOT regexp_full_match(t, '\p{{Nd}}+') AND NOT list_contains(string_split('" + " ".join(tx.STOP_WORDS) + "', ' '), t))"
_VARIANTS = "(SELECT item_id * 8 AS item_id, text FROM benchmark UNION ALL SELECT item_id * 8 + 1, substr(text, length(text) // 2 + 1) FROM benchmark)"
_FINISH = (
    """
hyd AS (SELECT f.*, d.text, TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 700 AS INTEGER)) AS happened FROM fused f JOIN documents d USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rec AS (SELECT *, score * (1 + pow(0.5, greatest(0, epoch(TIMESTAMP '2026-01-01') - epoch(happened)) / 86400.0 / 365)) AS final FROM hyd),
gated AS (SELECT rec.*, row_number() OVER (PARTITION BY item_id ORDER BY round(final, 9) DESC, doc_id) AS place FROM rec JOIN (SELECT item_id, """
    + _CONTENT.format("text")
    + " AS qt FROM benchmark) USING (item_id) WHERE len(list_intersect("
    + _CONTENT.format("text")
    + """, qt)) > 0 OR sim >= 0.5)
SELECT item_id, doc_id, round(final, 6) AS score, place FROM gated WHERE place <= 8"""
)


@query(
    bm25_sql(queries=_VARIANTS)
    + f""", pool AS (SELECT item_id // 8 AS item_id, doc_id, 1.0 / (60 + rank) AS share FROM ranked WHERE rank <= 96),
fused AS (SELECT item_id, doc_id, sum(share) AS score, NULL::DOUBLE AS sim FROM pool WHERE {_FILTERED} GROUP BY 1, 2),"""
    + _FINISH
)
def ret_01_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search with a variant of each query, sources, a time bound, excluded ids and hidden records, at depth balanced."""
    records, asked = dated(spark, sf_dir), asked_texts(spark, sf_dir)
    second = asked.select("query_id", F.lit(1).alias("variant"), F.expr("substring(text, cast(length(text) div 2 + 1 as int))").alias("text"))
    allowed = records.where(F.col("source").isin("src0", "src1", "src2", "src3", "src4", "src5") & rules.within(F.col("at"), F.expr("TIMESTAMP '2024-03-01'"), None)).select("id")
    excluded = asked.select("query_id", (F.col("query_id") * 3).alias("id"))
    best = search.hybrid(records, asked.union(second), now(), allowed=allowed, excluded=excluded, hidden=toxic(spark, sf_dir), depth="balanced")
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("place"))


_LINKS = "SELECT doc_id AS record, 's' || source AS entity FROM documents UNION SELECT vec_id, 'l' || label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, entity): the source of each document, and the label of its vector."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record"), F.concat(F.lit("s"), "source").alias("entity"))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record"), F.concat(F.lit("l"), "label").alias("entity"))
    return docs.union(labels.join(docs.select("record"), "record", "left_semi").select("record", "entity"))


@query(
    bm25_sql()
    + f""", base AS (SELECT item_id, doc_id, 1.0 / (60 + rank) AS score FROM ranked WHERE rank <= 96),
l AS ({_LINKS}),
o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY record ORDER BY entity) <= 6),
i AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY entity ORDER BY record DESC) <= 16),
s AS (SELECT item_id, doc_id AS record, score / sum(score) OVER (PARTITION BY item_id) AS p FROM (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 6)),
v1 AS (SELECT item_id, record FROM s UNION SELECT s.item_id, i.record FROM s JOIN o USING (record) JOIN i USING (entity)),
v AS (SELECT item_id, record FROM v1 UNION SELECT v1.item_id, i.record FROM v1 JOIN o USING (record) JOIN i USING (entity)),
own AS (SELECT v.item_id, v.record, o.entity, count(*) OVER (PARTITION BY v.item_id, v.record) AS n FROM v JOIN o USING (record)),
back AS (SELECT v.item_id, v.record, i.entity, count(*) OVER (PARTITION BY v.item_id, i.entity) AS n FROM v JOIN i USING (record) WHERE EXISTS (SELECT 1 FROM own w WHERE w.item_id = v.item_id AND w.entity = i.entity)),
e1 AS (SELECT item_id, entity, sum(p / n) AS m FROM own JOIN s USING (item_id, record) GROUP BY 1, 2),
r1 AS (SELECT item_id, record, sum(m / n) AS g FROM e1 JOIN back USING (item_id, entity) GROUP BY 1, 2),
m1 AS (SELECT v.item_id, v.record, 0.4 * coalesce(p, 0) + 0.6 * coalesce(g, 0) AS m FROM v LEFT JOIN s USING (item_id, record) LEFT JOIN r1 USING (item_id, record)),
e2 AS (SELECT item_id, entity, sum(m / n) AS m FROM own JOIN m1 USING (item_id, record) GROUP BY 1, 2),
r2 AS (SELECT item_id, record, 0.6 * sum(m / n) AS g FROM e2 JOIN back USING (item_id, entity) GROUP BY 1, 2),
lead AS (SELECT item_id, record AS doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(g, 9) DESC, record) AS rank FROM r2 WHERE g > 1e-9 AND NOT EXISTS (SELECT 1 FROM s WHERE s.item_id = r2.item_id AND s.record = r2.record)),
fused AS (SELECT item_id, doc_id, sum(score) AS score, NULL::DOUBLE AS sim FROM (SELECT * FROM base UNION ALL SELECT item_id, doc_id, 0.3 / (60 + rank) FROM lead WHERE rank <= 256) GROUP BY 1, 2),"""
    + _FINISH
)
def ret_02_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search with leads: diffusion from the six best records over what they share, as a channel of small weight."""
    best = search.hybrid(dated(spark, sf_dir), asked_texts(spark, sf_dir), now(), hidden=toxic(spark, sf_dir), links=links(spark, sf_dir), depth="balanced")
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("place"))


@query(
    bm25_sql()
    + """  , held AS (SELECT doc_id AS record, 's' || source AS entity, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 700 AS INTEGER)) AS t FROM documents),
own AS (SELECT DISTINCT 's' || source AS account, 'p' || (length(source) + ascii(right(source, 1)) % 4) AS person, TIMESTAMP '2024-01-01' + to_days(CAST(ascii(right(source, 1)) % 7 * 30 AS INTEGER)) AS f, CASE WHEN ascii(right(source, 1)) % 3 > 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(ascii(right(source, 1)) % 7 * 30 + 300 AS INTEGER)) END AS u FROM documents),
rel AS (SELECT DISTINCT person, record FROM held JOIN own ON account = entity WHERE f <= t AND (u IS NULL OR t < u)),
n AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY record) AS n FROM rel),
seed AS (SELECT item_id, doc_id AS record FROM ranked WHERE rank <= 6)
SELECT item_id, seed.record AS from_record, n.record AS id, n.person AS via FROM seed JOIN held ON held.record = seed.record JOIN own ON account = entity AND f <= t AND (u IS NULL OR t < u) JOIN n ON n.person = own.person AND n.n <= 16 AND n.record <> seed.record"""
)
def join_06_identity_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the owners of the accounts of the best records have to do with, by identities valid at the records' times."""
    docs = dated(spark, sf_dir).select(F.col("id").alias("record"), F.concat(F.lit("s"), "source").alias("entity"), "source", "at")
    last = F.ascii(F.right("source", F.lit(1)))
    day = lambda n: F.timestamp_add("DAY", n, F.expr("TIMESTAMP '2024-01-01'"))
    identities = docs.select(F.col("entity").alias("account"), F.concat(F.lit("p"), F.length("source") + last % 4).alias("person"), day(last % 7 * 30).alias("valid_from"), F.when(last % 3 > 0, day(last % 7 * 30 + 300)).alias("valid_to")).distinct()
    seeds = bm25_top(spark, sf_dir, 6).select("query_id", F.col("doc_id").alias("record")).join(docs.select("record", "at"), "record")
    found = cl.bridged(seeds, docs.select("record", "entity", "at"), identities)
    return found.select(F.col("query_id").alias("item_id"), "from_record", "id", "via")


@query(
    """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, e.vec_id, e.vec_id // 4 AS record, list_cosine_similarity(q.v, e.embedding::DOUBLE[]) AS sim FROM q, embeddings e WHERE e.vec_id <> q.query_id),
b AS (SELECT * FROM s WHERE sim >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id, record ORDER BY round(sim, 9) DESC, vec_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM b)
SELECT query_id, record, round(sim, 6) AS similarity, rank, (vec_id % 4) * 1800 AS start, substr(text, CAST((vec_id % 4) * 1800 + 1 AS INTEGER), 2400) AS piece FROM r JOIN documents d ON d.doc_id = r.record WHERE rank <= 10"""
)
def win_02_best_vector_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest records of a vector by their best chunks, none under a floor, each with the text from that chunk on.

    Four vectors stand for the chunks of one record.
    """
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    best = retrieval.neighbours(vectors, asked, 10, floor=0.1, per_record=4)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record"), "text")
    start = (F.col("id") % 4) * 1800
    return best.join(texts, "record").select("query_id", "record", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"), start.alias("start"), F.substring("text", start.cast("int") + 1, F.lit(2400)).alias("piece"))


@query(
    """
WITH state AS (SELECT o_custkey, bool_and(o_orderstatus <> 'O') AS done FROM orders GROUP BY 1),
cover AS (SELECT c_nationkey AS domain, bool_and(coalesce(done, false)) AS covered FROM customer LEFT JOIN state ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1),
b AS (SELECT event_id, CAST(user_id % 25 AS INTEGER) AS domain, ['value', 'none', 'all', 'some'][1 + event_id % 4] AS quantifier FROM events)
SELECT event_id, quantifier = 'value' OR (quantifier IN ('none', 'all') AND coalesce(covered, false)) AS accepted FROM b LEFT JOIN cover USING (domain)"""
)
def knw_03_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A belief that speaks of none or all needs its domain's sources complete."""
    states = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.when(F.bool_and(F.col("o_orderstatus") != "O"), "complete").otherwise("partial").alias("state"))
    required = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").cast("int").alias("domain"), F.col("c_custkey").alias("source"))
    quantifier = F.get(F.array(*map(F.lit, ("value", "none", "all", "some"))), (F.col("event_id") % 4).cast("int"))
    beliefs = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).cast("int").alias("domain"), quantifier.alias("quantifier"))
    return cl.gated(beliefs, knowledge.covered(required, states, "domain", "source"), "domain").select("event_id", "accepted")


@query(
    """
WITH b AS (SELECT event_id AS id, user_id AS subject, event_type AS predicate, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 5 = 0 THEN 'retracted' ELSE 'recorded' END AS state,
 lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS supersedes FROM events),
gone AS (SELECT DISTINCT o.id FROM b c JOIN b o ON o.id = c.supersedes AND o.subject = c.subject AND o.predicate = c.predicate WHERE c.state = 'recorded' AND c.id % 2 = 0)
SELECT b.id, CASE WHEN g.id IS NOT NULL THEN 'superseded' ELSE state END AS state FROM b LEFT JOIN gone g USING (id)"""
)
def knw_04_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections: every second belief corrects the subject's belief before it, which counts where the predicate is the same."""
    from pyspark.sql import Window

    k = F.get_json_object("props", "$.k").cast("long")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    beliefs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.when(k % 5 == 0, "retracted").otherwise("recorded").alias("state"), before.alias("supersedes"))
    corrections = beliefs.where("id % 2 = 0 and supersedes is not null").select("id", "supersedes")
    return cl.resolved(beliefs.drop("supersedes"), corrections, ["subject", "predicate"]).select("id", "state")


@query(
    """
WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1800)) AS start FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, substr(text, CAST(start AS INTEGER) + 1, 2000) AS piece, text FROM s WHERE start = 0 OR start + 200 < length(text))
SELECT doc_id, count(*) AS n_spans, count(*) FILTER (WHERE contains(piece, substr(text, 1901, 50))) AS n_with FROM p GROUP BY doc_id"""
)
def flt_16_quote_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many of a text's spans a quote stands whole: here what begins at its 1901st character."""
    spans = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1901, 50).alias("quote"), tx.spans("text").alias("s")).where("s is not null")
    holds = F.filter("s", lambda s: F.contains(s["piece"], F.col("quote")))
    return spans.select("doc_id", F.size("s").cast("long").alias("n_spans"), F.size(holds).cast("long").alias("n_with"))


@query(
    bm25_sql(queries=_VARIANTS)
    + f""", hit AS (SELECT item_id // 8 AS item_id, item_id % 8 AS search, doc_id, rank FROM ranked WHERE rank <= 32 AND doc_id NOT IN {_DEAD}),
rd AS (SELECT item_id, branch, doc_id, row_number() OVER (PARTITION BY item_id, branch ORDER BY rank, doc_id) AS round FROM hit JOIN (VALUES (0, 0), (1, 1), (0, 2)) b(search, branch) USING (search)),
m AS (SELECT item_id, doc_id, min(round * 10 + branch) AS first, list_sort(list(DISTINCT branch)) AS branches FROM rd WHERE round <= 8 GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY first, doc_id) AS place FROM m)
SELECT item_id, doc_id, CAST(first // 10 AS INTEGER) AS round, CAST(first % 10 AS INTEGER) AS branch, branches, place FROM p WHERE place <= 18"""
)
def ret_08_investigate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three branches of each query, two of them the same and searched once; live records only, taken in turns."""
    text = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    second = F.expr("substring(text, cast(length(text) div 2 + 1 as int))")
    told = text.select("query_id", F.explode(F.array(F.struct(F.lit(0).alias("branch"), F.col("text").alias("text")), F.struct(F.lit(1).alias("branch"), second.alias("text")), F.struct(F.lit(2).alias("branch"), F.col("text").alias("text")))).alias("b")).select("query_id", "b.*")
    searches, answers = recall.shared_searches(told)
    found = retrieval.bm25(table(spark, sf_dir, "documents"), searches.select((F.col("query_id") * 8 + F.col("search")).alias("query_id"), "text"), retrieval.POOLS["fast"])
    hits = found.select(F.expr("query_id div 8").alias("query_id"), (F.col("query_id") % 8).cast("int").alias("search"), F.col("doc_id").alias("id"), "rank")
    dead = toxic(spark, sf_dir).distinct().withColumn("dead", F.lit(True))
    merged = recall.branches(hits.join(answers, ["query_id", "search"]).join(dead, "id", "left"), F.col("dead").isNull(), 8, 18)
    return merged.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "round", "branch", "branches", F.col("place").cast("long").alias("place"))


@query(
    bm25_sql()
    + f""", hit AS (SELECT item_id, count(*) AS n FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 10 AND d.source = 'src7' GROUP BY 1),
c AS (SELECT item_id, count(*) AS n_claims FROM ranked r JOIN documents d USING (doc_id) JOIN {_CLAIMS} k ON k.record_id = r.doc_id WHERE rank <= 10 AND d.source = 'src7' AND k.status = 'active' GROUP BY 1)
SELECT b.item_id, coalesce(n, 0) AS n_episodes, least(coalesce(n_claims, 0), 10) AS n_claims, CASE WHEN n > 0 THEN 'candidates_found' WHEN b.item_id NOT IN (SELECT vec_id FROM embeddings) THEN 'retrieval_incomplete' ELSE 'no_relevant_evidence' END AS status
FROM benchmark b LEFT JOIN hit USING (item_id) LEFT JOIN c USING (item_id)"""
)
def ret_06_claims_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search found: episodes, their claims, and whether finding nothing tells anything: it does not for items that the
    vector channel does not know.
    """
    kept = table(spark, sf_dir, "documents").where("source = 'src7'").select("doc_id")
    hits = bm25_top(spark, sf_dir, 10).join(kept, "doc_id", "left_semi").select("query_id", F.col("doc_id").alias("record_id"), "rank")
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    told = cl.attached(hits, claims(spark, sf_dir), [F.desc("turn"), F.col("id")], 10).groupBy("query_id").agg(F.count("*").alias("n_claims"))
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.lit(True).alias("known")).distinct()
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(n, "query_id", "left").join(told, "query_id", "left").join(known, "query_id", "left")
    none = F.lit(0).cast("long")
    return items.select(F.col("query_id").alias("item_id"), F.coalesce("n", none).alias("n_episodes"), F.coalesce("n_claims", none).alias("n_claims"), recall.status(F.coalesce("n", none), F.col("known").isNull()).alias("status"))
