"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is its words between white space; of these, one that is longer than LONG_WORD or written in a script without
spaces counts as its characters. Of every k-mer of K_WORDS words the inner substrings are its S_WORDS-word stretches; the
k-mer is a closed syncmer if the least hash among these is its first or its last. The choice looks at the k-mer alone, so
an edit moves only the anchors that it touches. The fingerprint is the SHA-256 of the list of all anchors in order, a
colon, and this list: numbers, place of the first word times 2**32 plus hash of the k-mer.

Two texts are matched by place as well as by anchor: an anchor of one meets an equal one of the other whose next anchor
stands as many words ahead, wherever in the texts both stand. The likeness is the share of distinct such steps (anchor,
words to the next) that both texts have, out of all of them.

A text of fewer than K_WORDS words, or without a syncmer, gives the hash of all its words at place 0; one without words
(null, empty) an empty fingerprint. Two empty ones are alike (1), an empty and another are not (0). Whole texts of any
length count. Rows of a null id stand outside the order and are followed by an empty text. A repeated id counts once in
the order; each of its rows gives one row, and as a next document it is its row with the least beginning. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

K_WORDS, S_WORDS, LONG_WORD = 5, 2, 40
# The blocks of scripts written without spaces (Thai and Lao, Burmese, Khmer, kana, Han), as ranges, for they
# are looked for in every character.
_UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"
_LOW = 0xFFFFFFFF
_INNER = K_WORDS - S_WORDS + 1


def with_words(df: DataFrame, text: str, words: str) -> DataFrame:
    """df with the words of a text."""
    df = df.withColumn(words, F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    odd = F.exists(words, lambda w: F.length(w) > LONG_WORD) | ((F.octet_length(text) != F.length(text)) & F.col(text).rlike(_UNSPACED))
    cut = F.flatten(F.transform(words, lambda w: F.when((F.length(w) > LONG_WORD) | w.rlike(_UNSPACED), F.array_remove(F.split(w, ""), "")).otherwise(F.array(w))))
    return df.withColumn(words, F.when(odd, cut).otherwise(F.col(words)))


def with_inner(df: DataFrame, words: str, inner: str) -> DataFrame:
    """df with the hashes of the stretches of its words."""
    ahead = F.greatest(F.size(words) - 1, F.lit(0))
    return df.withColumn(inner, F.zip_with(F.slice(words, 1, ahead), F.slice(words, 2, ahead), lambda a, b: F.hash(a, b)))


def placed(place: Column, hashed: Column) -> Column:
    return F.shiftleft(place.cast("long"), 32).bitwiseOR(hashed.cast("long").bitwiseAND(F.lit(_LOW)))


def anchor_in(inner: str):
    """Place (times 2**32) plus hash of the k-mer at a place, null if it is no closed syncmer."""

    def anchor(first: Column, i: Column) -> Column:
        others = [F.get(inner, i + j) for j in range(1, _INNER)]
        closed = F.least(first, *others).isin(first, others[-1]) & others[-1].isNotNull()
        return F.when(closed, placed(i, F.hash(first, *others)))

    return anchor


def with_anchors(df: DataFrame, text: str, found: str) -> DataFrame:
    """df with its text's closed syncmers in order, an array of place times 2**32 plus hash."""
    words, inner = f"__w_{found}", f"__s_{found}"
    df = with_inner(with_words(df, text, words), words, inner)
    df = df.withColumn(found, F.array_compact(F.transform(F.col(inner), anchor_in(inner))))
    whole = F.array(placed(F.lit(0), F.hash(F.lit(K_WORDS), F.col(words))))
    df = df.withColumn(found, F.when((F.size(found) == 0) & (F.size(words) > 0), whole).otherwise(F.col(found)))
    return df.drop(words, inner)


def with_written(df: DataFrame, found: str, name: str) -> DataFrame:
    """df with the fingerprint: a digest of all anchors, and these."""
    df = df.withColumn(name, F.col(found).cast("string"))
    return df.withColumn(name, F.when(F.size(found) == 0, "").otherwise(F.concat(F.sha2(name, 256), F.lit(":"), name)))


def steps(found: str) -> Column:
    """The distinct steps of a text: its anchors, each with the distance to the next (0 after the last)."""
    following = F.slice(F.col(found), 2, F.greatest(F.size(found), F.lit(1)))
    gap = lambda a, b: F.coalesce(F.shiftright(b, 32) - F.shiftright(a, 32), F.lit(0).cast("long"))
    return F.array_distinct(F.zip_with(F.col(found), following, lambda a, b: F.hash(a.bitwiseAND(F.lit(_LOW)), gap(a, b))))


def likeness(a: str, b: str) -> Column:
    """The share of steps in common of two arrays of distinct ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def followers(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids in rising order, the last followed by the first.

    Ids are dealt to ranges of about equal numbers, however they lie; only the least id of each range is put in one order.
    """
    dealt = ids.where("doc_id is not null").select("doc_id").distinct().repartitionByRange("doc_id")
    at = cut(dealt.select("doc_id", F.spark_partition_id().alias("b")))
    order = Window.orderBy("b")
    least = F.min("least").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = at.groupBy("b").agg(F.min("doc_id").alias("least")).select("b", F.coalesce(F.lead("least").over(order), least).alias("after"))
    inside = at.select("doc_id", "b", F.lead("doc_id").over(Window.partitionBy("b").orderBy("doc_id")).alias("next_id"))
    return inside.join(after, "b").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of docs (doc_id, text).

    The edited text is the document's with its last half replaced by as much of the next document's beginning.
    """
    named = docs.select("doc_id", "text")
    if dict(named.dtypes) != {"doc_id": "bigint", "text": "string"}:
        named = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = named.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = every.where("doc_id is not null")
    halves = base.groupBy("doc_id").agg(F.max(F.expr("cast(length(text) div 2 as int)")).alias("half"))
    order = followers(base).join(halves, "doc_id").select(F.col("doc_id").alias("before"), F.col("next_id").alias("doc_id"), "half")
    # Both joins take the same (doc_id, text) by doc_id, so texts are shuffled once; the second moves beginnings and
    # distinct steps only. Anchors come after the shuffle, for lambdas keep Spark from seeing that the two sides are equal.
    ahead = with_anchors(base.join(order, "doc_id"), "text", "found")
    heads = ahead.select(F.col("before").alias("doc_id"), F.expr("left(text, half)").alias("head"), steps("found").alias("next_steps"))
    heads = heads.groupBy("doc_id").agg(F.min(F.struct("head", "next_steps")).alias("h")).select("doc_id", "h.head", "h.next_steps")
    both = base.join(heads, "doc_id").select("doc_id", "text", "head", "next_steps")
    alone = every.where("doc_id is null").select("doc_id", "text", F.lit("").alias("head"), F.expr("cast(array() as array<int>)").alias("next_steps"))
    edited = F.expr("concat(left(text, cast(length(text) - length(text) div 2 as int)), left(head, cast(length(text) div 2 as int)))")
    both = with_written(with_anchors(both.union(alone), "text", "found"), "found", "fingerprint")
    both = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "next_steps", "fingerprint", steps("found").alias("own_steps"))
    both = with_written(with_anchors(both, "edited", "found"), "found", "edited_fingerprint").withColumn("edited_steps", steps("found"))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("own_steps", "edited_steps").alias("near_edited"),
        likeness("own_steps", "next_steps").alias("near_next"),
    )
