"""Hybrid retrieval: BM25, exact cosine neighbours, rank fusion, recency, gate and quality metrics.

Queries are a stated set, taken in blocks of a bounded size; what is searched is of any size. BM25 and cosine search score
a block of queries inside each task, which keeps the best of each query only, so that no row is shuffled for a pair that
cannot be among the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import query_terms, tokens
from ..session import spread

K1, B = 1.2, 0.75
RRF_BASE = 60
POOLS = {"fast": 32, "balanced": 96, "deep": 256}
#: Queries that are scored together, and the bytes of their vectors.
QUERY_BLOCK, VECTOR_BYTES = 2048, 32 << 20
#: Rows (terms or vectors) that are scored together.
SCORED_ROWS = 1 << 17


class Best:
    """The k best ids of each query so far, by score to nine digits, then id; with `groups`, each group's best id only."""

    def __init__(self, queries: int, k: int, groups: int = 1):
        self.k, self.groups, self.held, self.size, self.least = k, groups, [[] for _ in range(queries)], [0] * queries, np.full(queries, -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray, queries: np.ndarray | None = None) -> None:
        """scores: (queries, ids), of all queries or those with the numbers given; -inf is no match."""
        for r in np.flatnonzero(scores.max(axis=1, initial=-np.inf) > -np.inf).tolist():
            q = r if queries is None else int(queries[r])
            at = np.flatnonzero((scores[r] >= self.least[q]) & (scores[r] > -np.inf))
            if len(at):
                self.held[q].append((ids[at], scores[r][at]))
                self.size[q] += len(at)
                if self.size[q] > 4 * self.k:
                    self._prune(q)

    def _prune(self, q: int) -> None:
        ids, scores = (np.concatenate(c) for c in zip(*self.held[q], strict=True))
        by_id = np.argsort(ids, kind="stable")
        order = by_id[np.argsort(-scores[by_id].round(9), kind="stable")]
        if self.groups > 1:
            order = order[np.sort(np.unique(ids[order] // self.groups, return_index=True)[1])]
        order = order[: self.k]
        self.held[q], self.size[q] = [(ids[order], scores[order])], len(order)
        if len(order) == self.k:
            self.least[q] = scores[order].min() - 1e-8

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's number, ids, scores) of each query that has any."""
        for q in range(len(self.held)):
            if self.size[q]:
                self._prune(q)
                yield q, *self.held[q][0]


def _batches(best: Best, names: list, kind: pa.DataType, id_kind: pa.DataType, label: str) -> Iterator[pa.RecordBatch]:
    """What is best, as batches of (query_id, id, score)."""
    for q, ids, scores in best.rows():
        yield pa.RecordBatch.from_arrays([pa.array([names[q]] * len(ids), kind), pa.array(ids, id_kind), pa.array(scores, pa.float64())], names=["query_id", "id", label])


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _blocks(queries: DataFrame, size: int) -> Iterator[DataFrame]:
    blocks = max(1, -(-queries.count() // size))
    for b in range(blocks):
        yield queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", block: int = QUERY_BLOCK, only: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents of each query (query_id, text) that hold a term of it.

    One scan counts the documents of each wanted term, and one for each block of queries scores them: a task joins its
    texts' terms with the block's, which are broadcast, and adds up the scores of one document after the other. `only`
    says which documents may be found; the counts are those of all. Documents without a token count nowhere, queries without one find nothing; of queries that repeat an id the terms are one set.
    """
    spark, out = docs.sparkSession, None
    held = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.lit(True) if only is None else only).alias("only")))
    held = held.select("doc_id", tokens("text").alias("t"), "only").where(F.size("t") > 0)
    for part in _blocks(queries.where("query_id is not null"), block):
        wanted: dict[str, list] = {}
        names: dict[object, int] = {}
        for row in part.select("query_id", F.explode(query_terms("text")).alias("term")).distinct().collect():
            wanted.setdefault(row.term, []).append(names.setdefault(row.query_id, len(names)))
        terms = spark.createDataFrame([*((t, i) for i, t in enumerate(wanted)), ("", -1)], "term string, i int")
        seen = held.select(F.size("t").alias("dl"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("t"))).alias("term"))
        counts = {r.i: r for r in seen.join(F.broadcast(terms), "term").groupBy("i").agg(F.count("*").alias("n"), F.avg("dl").alias("dl")).collect()}
        n, avgdl = (counts[-1].n, counts[-1].dl) if -1 in counts else (0, 1.0)
        df = np.array([counts[i].n if i in counts else 0 for i in range(len(wanted))], np.float64)
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        first = np.cumsum([0, *map(len, wanted.values())])
        shared = spark.sparkContext.broadcast((list(names), first, np.array(sum(wanted.values(), []), np.int64), idf))
        kinds = [_arrow(f.dataType) for f in part.select("query_id").schema.fields + held.select("doc_id").schema.fields]

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, avgdl=avgdl, kinds=kinds) -> Iterator[pa.RecordBatch]:
            """Rows (doc_id, row, dl, i): the terms of one document stand together."""
            names, first, owners, idf = shared.value
            best, held, size = Best(len(names), k), [], 0

            def score(rows: list[tuple], last: bool) -> list[tuple]:
                ids, row, dl, i = (np.concatenate(c) for c in zip(*rows, strict=True))
                stop = len(row) if last else int(np.flatnonzero(row != row[-1])[-1] + 1) if row[0] != row[-1] else 0
                if stop:
                    start = np.flatnonzero(np.diff(row[:stop], prepend=row[0] - 1))
                    doc = np.repeat(np.arange(len(start)), np.diff([*start, stop]))
                    pair, tf = np.unique(doc * len(idf) + i[:stop], return_counts=True)
                    at, term = np.divmod(pair, len(idf))
                    share = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[start][at] / avgdl))
                    many = np.diff(first)[term]
                    query = owners[np.repeat(first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    place = np.repeat(at, many) + query * len(start)
                    sums = np.bincount(place, np.repeat(share, many), len(names) * len(start))
                    best.add(ids[start], np.where(np.bincount(place, minlength=len(sums)) > 0, sums, -np.inf).reshape(len(names), -1))
                return [(ids[stop:], row[stop:], dl[stop:], i[stop:])] if stop < len(row) else []

            step = max(1, min(SCORED_ROWS, (1 << 24) // max(1, len(names))))
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    held.append(tuple(c.to_numpy(zero_copy_only=False) for c in part.columns))
                    size += part.num_rows
                    if size >= step:
                        held = score(held, False)
                        size = len(held[0][1]) if held else 0
            if held:
                score(held, True)
            yield from _batches(best, names, *kinds, "score")

        found = held.where("only").withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.size("t").alias("dl"), F.explode("t").alias("term"))
        found = found.join(F.broadcast(terms.where("i >= 0")), "term").select("doc_id", "row", "dl", "i")
        schema = T.StructType([T.StructField("query_id", part.schema["query_id"].dataType), T.StructField("id", held.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
        some = found.mapInArrow(scan, schema)
        out = some if out is None else out.union(some)
    return top(out.withColumnRenamed("id", "doc_id"), "query_id", F.round("score", 9), "doc_id", k)


def top(scored: DataFrame, by: str | list[str], score: Column, tie: str, k: int) -> DataFrame:
    """The k best rows of each key with their rank, ties to the smaller id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(score.desc(), F.col(tie)))).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", floor: float | None = None, same: bool = False, per_record: int = 1) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest by cosine for each query (query_id, vector), exactly.

    The queries are taken in blocks of VECTOR_BYTES; each scan of the vectors scores one block with matrix products and a
    task keeps k candidates for each query. Null or zero vectors, and those of another dimension than the
    longest query's, have no similarity; one under `floor` is no match. A query's own id is left out unless `same`. An id that stands for
    several vectors comes several times. With per_record, id // per_record is the record that a vector is a chunk of, and
    of each record its best chunk only is found: a record's best chunk is also the best of its task, so this loses none.
    """
    spark, out = vectors.sparkSession, None
    numbered = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("vector")).where("query_id is not null and size(vector) > 0")
    width = numbered.select(F.size("vector").alias("n")).orderBy(F.desc("n")).first()
    width = width.n if width else 0
    for rows in _blocks(numbered.where(F.size("vector") == width), max(1, VECTOR_BYTES // max(8, 8 * width))):
        rows = rows.collect()
        shared = spark.sparkContext.broadcast(([r.query_id for r in rows], np.array([r.vector for r in rows], np.float64).reshape(len(rows), width)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            length = np.linalg.norm(asked, axis=1, keepdims=True)
            asked, able = asked / np.where(length > 0, length, 1), length > 0
            best, own = Best(len(names), k, per_record), np.array(names, np.int64)[:, None]
            step = max(1, (1 << 22) // max(1, len(names)))
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    part = part.filter(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(part.column(1)), width), False))
                    if not part.num_rows or not len(names):
                        continue
                    m = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    ids, norm = part.column(0).to_numpy(zero_copy_only=False), np.linalg.norm(m, axis=1)
                    similarity = asked @ (m / np.where(norm > 0, norm, 1)[:, None]).T
                    fit = able & (norm > 0) & np.isfinite(similarity)
                    if floor is not None:
                        fit &= similarity >= floor
                    if not same:
                        fit &= own != ids
                    best.add(ids, np.where(fit, similarity, -np.inf))
            yield from _batches(best, names, pa.int64(), pa.int64(), "similarity")

        part = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(scan, "query_id long, id long, similarity double")
        out = part if out is None else out.union(part)
    if per_record > 1:
        best = top(out.withColumn("record", F.floor(F.col("id") / per_record)), ["query_id", "record"], F.round("similarity", 9), "id", 1)
        out = best.drop("rank")
    return top(out, "query_id", F.round("similarity", 9), "id", k)


def holding(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 256) -> DataFrame:
    """(query_id, doc_id): documents whose text holds the passage of an item (query_id, passage) byte for byte.

    A passage of three words or more has one between white space, which any text that holds it has as a word too: the
    longest such one picks the texts to look at, by their ids. Shorter passages, being a part of the stated items, are
    looked for in every text, block by block. Empty passages are held by none.
    """
    words = F.split("passage", r"\s")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    named = items.where("passage != ''").select("query_id", "passage", longest.alias("word"))
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    every = texts.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s"))).alias("word"))
    met = every.join(named.where("word is not null").select("query_id", "word"), "word").select("query_id", "doc_id").distinct()
    out = met.join(named.select("query_id", "passage"), "query_id").join(texts, "doc_id").where(F.contains("text", "passage")).select("query_id", "doc_id")
    short = [(r.query_id, r.passage) for r in named.where("word is null").select("query_id", "passage").distinct().collect()]
    for i in range(0, len(short), block):
        found = F.filter(F.array(*(F.struct(F.lit(q).alias("q"), F.lit(p).alias("p")) for q, p in short[i : i + block])), lambda s: F.contains(F.col("text"), s["p"]))
        out = out.union(texts.select(F.explode(found).alias("f"), "doc_id").select("f.q", "doc_id"))
    return out.distinct()


def fused(ranked: DataFrame, weight: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, channel, rank): each sighting adds weight / (RRF_BASE + rank)."""
    share = (F.lit(1.0) if weight is None else weight) / (RRF_BASE + F.col("rank"))
    return ranked.groupBy("query_id", "id").agg(F.sum(share).alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))


def rescaled(ranked: DataFrame, logit: str, window: int = 24) -> DataFrame:
    """The first `window` ranks of each query with scores in [1, 2] by their logits; the rest keep theirs."""
    over = Window.partitionBy("query_id")
    inside = F.when(F.col("rank") <= window, F.col(logit))
    low, high = F.min(inside).over(over), F.max(inside).over(over)
    band = F.when(high > low, 1 + (F.col(logit) - low) / (high - low)).otherwise(F.lit(1.0))
    return ranked.withColumn("score", F.when(F.col("rank") <= window, band).otherwise(F.col("score")))


def quality(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Mean recall@k, reciprocal rank and nDCG@k over the queries that have gold (query_id, doc_id)."""
    size = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hit = ranked.where(F.col("rank") <= k).join(gold, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    each = size.join(hit, "query_id", "left")
    return each.agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg(F.coalesce(F.col("hits"), F.lit(0)) / F.col("n_gold")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal), 6).alias("ndcg"),
    )


def budgeted(ranked: DataFrame, by: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """The stop rule: rows in order until the budget is used up; the last one is cut to what is left (`taken`)."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = ranked.withColumn("__before", before).where(F.col("__before") < budget)
    return held.withColumn("taken", F.least(size, F.lit(budget) - F.col("__before"))).drop("__before")


def interleaved(rows: DataFrame, branch: str, order: list[Column], key: str, limit: int) -> DataFrame:
    """Round-robin merge of branches: position in the branch first, then the branch; a key counts where it first stands."""
    dealt = rows.withColumn("round", F.row_number().over(Window.partitionBy(branch).orderBy(*order))).where(F.col("round") <= limit)
    first = dealt.groupBy(key).agg(F.min(F.struct("round", branch)).alias("at")).select(key, "at.*")
    return first.orderBy("round", branch, key).limit(limit)
