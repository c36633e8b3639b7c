"""The registered queries of the training-data operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .chat_format import formatted
from .common import fold_of, table
from .decontaminate import contaminated
from .dialogue_repair import audits
from .fingerprint import fingerprints
from .language import languages
from .license_scan import licenses
from .mixing import mixed
from .near_dedup import near_duplicates
from .packing import packed
from .periodic_runs import periodic_runs
from .quality import quality
from .secret_scan import secrets
from .toxicity import toxicity


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"), where=fold_of("doc_id", 5) != 0)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = languages(docs, docs.where(fold_of("doc_id", 4) != 2))
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return formatted(rows.unionByName(planted), public_tokenizers.path("byte_bpe_50k.json"), with_output=False)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality(docs, table(spark, sf_dir, "labels"), where=fold_of("doc_id", 5) != 0)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """The rows of op12: (conv_id, turn, role, text, absent); a dropped row stays as one that is absent."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("absent"), times.alias("copy")).drop("copy")


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits(damaged_turns(table(spark, sf_dir, "conversations")))


def looped_texts(docs: DataFrame) -> DataFrame:
    """The texts of op13: a tenth, by a hash of their ids, end in a loop of some of their own words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    rows = rows.withColumn("words", F.when(F.col("g").isNotNull(), F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", (F.col("g") % F.greatest(F.col("n"), F.lit(1))).cast("int"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    looped = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ahead = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.expr("cast(null as struct<start:bigint,length:bigint,period:bigint>)"), ahead)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_licenses": op2_licenses,
        "op3_toxicity": op3_toxicity,
        "op4_packing": op4_packing,
        "op5_language": op5_language,
        "op6_near_dedup": op6_near_dedup,
        "op7_chat": op7_chat,
        "op8_quality": op8_quality,
        "op9_fingerprint": op9_fingerprint,
        "op10_secrets": op10_secrets,
        "op11_mixing": op11_mixing,
        "op12_dialogue_repair": op12_dialogue_repair,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": pipeline,
    }


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN []::VARCHAR[]
                      WHEN len(ws) = 1 THEN [ws[1]]
                      ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s),
c AS (SELECT sh, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
x AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM c),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep
   AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT rep, rep FROM c UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), home AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT s.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(h.component, s.doc_id) AS component_id,
       s.doc_id = coalesce(h.component, s.doc_id) AS kept
FROM s JOIN n USING (doc_id) LEFT JOIN c ON c.sh = list_sort(s.sh) LEFT JOIN home h ON h.a = c.rep
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_near_dedup": _OP6}
