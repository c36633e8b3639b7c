"""Records made of other records: parts of files, measurements, extracts, old forms, and the ids that JSON holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settled

#: Characters of a part of a file.
PART = 60_000


def parts(files: DataFrame, key: str, text: str, size: int = PART) -> DataFrame:
    """files with a row for each part of their text: part (from 0), start, piece and its digest; an empty text is one part."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    each = files.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    each = each.withColumn("start", F.col("part") * size).withColumn("piece", F.substring(F.coalesce(text, F.lit("")), F.col("start") + 1, F.lit(size)))
    return each.withColumn("digest", F.sha2("piece", 256))


def copies(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """key..., status and copy_of: new, changed, unchanged or removed; a new item with the digest of one that was there
    before is a copy of the least such key.

    Digests are met once each, summed up before the join.
    """
    a = old.select(*key, F.col(digest).alias("__old"))
    b = new.select(*key, F.col(digest).alias("__new"))
    both = a.withColumn("__had", F.lit(True)).join(b.withColumn("__has", F.lit(True)), key, "full")
    status = F.when(F.col("__had").isNull(), "new").when(F.col("__has").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("changed")
    known = old.groupBy(F.col(digest).alias("__new")).agg(F.min(F.struct(*key)).alias("copy_of"))
    marked = both.withColumn("status", status).join(known, "__new", "left")
    return marked.select(*key, "status", F.when(F.col("status") == "new", F.col("copy_of")).alias("copy_of"))


def derived(parents: DataFrame, record_id: Column, blob: Column, text: Column, observed_at: Column) -> DataFrame:
    """Contract records of text drawn from attachments: their parent is named, so they are forgotten with it."""
    return parents.select(
        F.lit("1.0").alias("schema_version"),
        F.col("source"),
        F.concat(F.lit("attachment-text:"), blob).alias("source_id"),
        F.lit("1").alias("revision"),
        F.lit("attachment_text").alias("kind"),
        F.col("occurred_at"),
        observed_at.alias("observed_at"),
        text.alias("text"),
        F.concat(F.lit("blob://"), blob).alias("source_locator"),
        F.lit("derived").alias("origin"),
        F.array(record_id).alias("parent_record_ids"),
    )


def adapted(old: DataFrame, generated: list[str], observed_at: Column) -> DataFrame:
    """Records of the old form (source, source_id, text, revision, kind, occurred_at) in the contract's: defaults filled in,
    and the origin told by the source.
    """
    return old.select(
        F.lit("1.0").alias("schema_version"),
        "source",
        "source_id",
        F.coalesce("revision", F.lit("1")).alias("revision"),
        F.coalesce("kind", F.lit("episode")).alias("kind"),
        "occurred_at",
        observed_at.alias("observed_at"),
        "text",
        F.when(F.col("source").isin(generated), "assistant").otherwise("source").alias("origin"),
    )


def versions(edits: DataFrame, target: str, entry: str, order: str) -> DataFrame:
    """Edits (action add, replace or remove) of entries as their versions: live from `version` until `retired_version`.

    The version of a target counts its edits in order; an entry's version ends with its next edit. A removal ends one and
    begins none. clear ends every version of its target that is open.
    """
    number = F.row_number().over(Window.partitionBy(target).orderBy(order))
    by_target = Window.partitionBy(target).orderBy("version").rowsBetween(1, Window.unboundedFollowing)
    marked = edits.withColumn("version", number).withColumn("__clear", F.min(F.when(F.col("action") == "clear", F.col("version"))).over(by_target))
    following = F.lead("version").over(Window.partitionBy(target, entry).orderBy("version"))
    ended = marked.withColumn("retired_version", F.least(following, F.col("__clear")))
    return ended.where(F.col("action").isin("add", "replace")).drop("__clear")


def evidence_ids(rows: DataFrame, column: str) -> DataFrame:
    """rows with `record_ids`, the distinct ids that the JSON in column holds anywhere, sorted.

    Ids stand under record_id, in the lists record_ids and parent_record_ids, in the ids of `episodes`, and in objects that
    have id, source, source_id and text. The walk goes down level by level, a frontier of nodes at a time, as far as the
    deepest JSON has values; null and broken JSON (repeated keys too) hold none.
    """
    spark = rows.sparkSession
    held = settled(rows.withColumn("__row", F.monotonically_increasing_id()))
    frontier = held.select("__row", F.lit("").alias("under"), F.try_parse_json(column).alias("node")).where("node is not null")
    names, found = ("id", "source", "source_id", "text"), None
    text = lambda node, path: F.when(F.substring(F.to_json(F.try_variant_get(node, path, "variant")), 1, 1) == '"', F.try_variant_get(node, path, "string"))
    while True:
        kind = F.substring(F.to_json("node"), 1, 1)
        nodes = settled(frontier.withColumn("kind", kind).where(F.col("kind").isin("{", "[") | ((F.col("kind") == '"') & F.col("under").isin("record_id", "record_ids[]", "parent_record_ids[]"))))
        if nodes.isEmpty():
            break
        whole = F.lit(True)
        for name in names:
            whole = whole & F.try_variant_get("node", f"$.{name}", "variant").isNotNull()
        one = F.when(F.col("kind") == '"', F.try_variant_get("node", "$", "string")).when((F.col("kind") == "{") & (whole | (F.col("under") == "episodes[]")), text(F.col("node"), "$.id"))
        told = nodes.select("__row", one.alias("id")).where("id is not null").distinct()
        found = told if found is None else found.union(told)
        inner = nodes.where("kind != '\"'").lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        frontier = inner.select("__row", F.coalesce("key", F.concat("under", F.lit("[]"))).alias("under"), F.col("value").alias("node"))
    none = F.expr("cast(array() as array<string>)")
    if found is None:
        return held.drop("__row").withColumn("record_ids", none)
    each = found.groupBy("__row").agg(F.array_sort(F.collect_set("id")).alias("record_ids"))
    return held.join(each, "__row", "left").drop("__row").withColumn("record_ids", F.coalesce("record_ids", none))
