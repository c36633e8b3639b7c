"""A stored inverted index: BM25 without reading a text at query time, kept up by batches of changes.

Documents of a batch are dealt by hash to windows of about WINDOW; a row of `postings` is what one term has in one window:
ids, counts and lengths, and the greatest count and least length among them, which bound every score in the window,
whatever the statistics become. Rows lie in `shard` folders by term. `forward` has each document's length and terms,
`counts` by how much a batch changes the number of documents of each term, `gone` which documents of earlier batches a
batch retires, with the window that they stand in. Nothing is written in place (see `parts`).

A query reads the shards of its terms. Tasks take window after window: a query whose bounds there do not add up to its
k-th best score so far is passed over, and the lists of terms that no other query needs are not looked at. Documents that
are gone come to the same task as their windows do.

Ids are whole numbers; null ids and texts without a token are not indexed. Of rows that repeat an id in a batch the
greatest text counts, and if one of them is forgotten, the id is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import query_terms, tokens
from ..session import spread
from .parts import Parts
from .retrieval import B, K1, QUERY_BLOCK, Best, _batches, _blocks, top

#: Documents of a window, folders of terms, and windows of a shard that one task writes.
WINDOW, SHARDS, WRITTEN = 512, 32, 4096
_FORWARD = "id long, dl int, terms array<struct<term:string,tf:int>>"
_POSTINGS = "term string, window int, ids array<long>, tfs array<int>, dls array<int>, n int, most int, least int, shard int"
_COUNTS = "term string, n long, shard int"
_GONE = "id long, of int, window int"


def scored(shared, k: int, avgdl: float):
    """Rows (batch, window, i, ids, tfs, dls, most, least), sorted by the first three, to the k best of each query.

    i: the term's number, -1 in the row of a window that lists who is gone. A task holds one window's rows at a time.
    """

    def share(idf, tf, dl):
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, owners, idf = shared.value
        best, held, now = Best(len(names), k), [], None

        def window() -> None:
            dead = np.concatenate([r[1] for r in held if r[0] < 0]) if held and held[0][0] < 0 else None
            rows = [r for r in held if r[0] >= 0]
            if not rows:
                return
            term = np.array([r[0] for r in rows])
            many = np.diff(first)[term]
            own = owners[np.repeat(first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            bound = share(idf[term], np.array([r[4] for r in rows], np.float64), np.array([r[5] for r in rows], np.float64))
            reach = np.bincount(own, np.repeat(bound, many), len(names))
            alive = (reach > 0) & (reach >= best.least - 1e-8)
            needed = np.flatnonzero(np.bincount(np.repeat(np.arange(len(rows)), many), alive[own], len(rows)) > 0)
            if not len(needed):
                return
            asked = np.flatnonzero(alive)
            local = np.full(len(names), -1)
            local[asked] = np.arange(len(asked))
            size = [len(rows[r][1]) for r in needed]
            at = np.repeat(needed, size)
            ids, tf, dl = (np.concatenate([rows[r][c] for r in needed]) for c in (1, 2, 3))
            if dead is not None:
                live = ~np.isin(ids, dead)
                at, ids, tf, dl = at[live], ids[live], tf[live], dl[live]
            docs, place = np.unique(ids, return_inverse=True)
            add = share(idf[term[at]], tf.astype(np.float64), dl)
            times = many[at]
            begin = np.cumsum(many) - many
            query = local[own[np.repeat(begin[at] - np.cumsum(times) + times, times) + np.arange(times.sum())]]
            cell = query * len(docs) + np.repeat(place, times)
            add, cell = np.repeat(add, times)[query >= 0], cell[query >= 0]
            sums = np.bincount(cell, add, len(asked) * len(docs))
            seen = np.bincount(cell, minlength=len(sums)) > 0
            best.add(docs, np.where(seen, sums, -np.inf).reshape(len(asked), -1), asked)

        for batch in batches:
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            number, most, least = (batch.column(c).to_pylist() for c in (2, 6, 7))
            lists = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy(zero_copy_only=False)) for c in (3, 4, 5)]
            for r in range(batch.num_rows):
                if key[r] != now:
                    window()
                    held, now = [], key[r]
                held.append((number[r], *(values[offsets[r] : offsets[r + 1]] for offsets, values in lists), most[r], least[r]))
        window()
        yield from _batches(best, names, pa.int64(), pa.int64(), "score")

    return run


class Postings:
    """The index below `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, shards: int = SHARDS, window: int = WINDOW):
        self.spark, self.parts, self.shards, self.window = spark, Parts(spark, root), shards, window

    def _shard(self):
        return F.pmod(F.xxhash64("term"), F.lit(self.shards)).cast("int")

    def _placed(self, windows: int):
        return F.pmod(F.xxhash64("id"), F.lit(max(1, windows))).cast("int")

    def _live(self) -> DataFrame:
        """Each indexed document's last version: (id, dl, terms, batch)."""
        gone = self.parts.read("gone", _GONE).select("id", F.col("of").alias("batch"))
        return self.parts.read("forward", _FORWARD).join(gone, ["id", "batch"], "left_anti")

    def _add(self, batch: int, forward: DataFrame, retired: DataFrame | None = None, base: bool = False) -> None:
        """Writes a batch: new documents (id, dl, terms) and those (id, dl, terms, batch) that go."""
        parts = self.parts
        sums = lambda rows: rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        lost = None
        if retired is not None:
            # Retirements first: who goes is settled before anything new stands beside it.
            windows = {r.batch: max(1, int(r.figures["windows"])) for r in parts.commits()}
            of = F.create_map(*(F.lit(x) for pair in windows.items() for x in pair))
            parts.write(retired.select("id", F.col("batch").alias("of"), F.pmod(F.xxhash64("id"), of[F.col("batch")]).cast("int").alias("window")), "gone", batch)
            lost = sums(retired)
        parts.write(forward, "forward", batch)
        written = self.spark.read.schema(_FORWARD).parquet(f"{parts.root}/forward/batch={batch}")
        new = sums(written)
        windows = -(-new.n // self.window)
        each = written.select("id", "dl", self._placed(windows).alias("window"), F.explode("terms").alias("t")).select("id", "dl", "window", "t.term", "t.tf")
        each = each.withColumn("shard", self._shard()).withColumn("slot", F.floor(F.col("window") / WRITTEN))
        # One shuffle: rows are dealt by shard and stretch of windows, within which they are grouped.
        lists = each.repartition("shard", "slot").groupBy("shard", "slot", "term", "window").agg(F.sort_array(F.collect_list(F.struct("id", "tf", "dl"))).alias("p"))
        lists = lists.select("term", "window", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"), F.size("p").alias("n"), F.array_max("p.tf").alias("most"), F.array_min("p.dl").alias("least"), "shard", "slot")
        parts.write(lists.sortWithinPartitions("shard", "term", "window").drop("slot"), "postings", batch, "shard")
        change = self.spark.read.schema(_POSTINGS).parquet(f"{parts.root}/postings/batch={batch}").select("term", "n", "shard") if new.n else self.spark.createDataFrame([], "term string, n int, shard int")
        if retired is not None:
            change = change.union(retired.select(F.explode("terms.term").alias("term"), F.lit(-1).alias("n")).select("term", "n", self._shard().alias("shard")))
        parts.write(change.groupBy("shard", "term").agg(F.sum("n").alias("n")).where("n != 0").repartition("shard"), "counts", batch, "shard")
        parts.commit(batch, base, windows=windows, docs=new.n - (lost.n if lost else 0), length=new.dl - (lost.dl if lost else 0))

    @staticmethod
    def _counted(texts: DataFrame) -> DataFrame:
        """texts (id, text), one row an id, dealt by id, as (id, dl, terms)."""
        cut = texts.select("id", tokens("text").alias("t")).where(F.size("t") > 0)
        each = cut.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
        return each.groupBy("id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))

    def build(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "Postings":
        """A new index of docs in place of what there was. Their texts are read once and moved once."""
        rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).where("id is not null")
        self._add(self.parts.next_batch(), self._counted(rows.groupBy("id").agg(F.max("text").alias("text"))), base=True)
        return self

    def change(self, changes: DataFrame, id_col: str = "doc_id", text_col: str = "text", forgotten_col: str = "forgotten") -> "Postings":
        """Applies one batch of new, changed and forgotten documents (id, text, forgotten)."""
        rows = changes.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(forgotten_col), F.lit(False)).alias("gone")).where("id is not null")
        rows = rows.groupBy("id").agg(F.max("text").alias("text"), F.max("gone").alias("gone"))
        retired = self._live().join(rows.select("id"), "id", "left_semi") if self.parts.commits() else None
        self._add(self.parts.next_batch(), self._counted(rows.where("not gone")), retired, base=retired is None)
        return self

    def merge(self) -> "Postings":
        """All parts as one, without what is gone; no text is read."""
        self._add(self.parts.next_batch(), self._live().select("id", "dl", "terms"), base=True)
        return self

    def search(self, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
        """(query_id, doc_id, score, rank): what `retrieval.bm25` finds in the live documents for queries (query_id, text)."""
        out, n, length = None, self.parts.figure("docs"), self.parts.figure("length")
        avgdl = length / n if n else 1.0
        for part in _blocks(queries.where("query_id is not null"), block):
            wanted: dict[tuple[str, int], list] = {}
            names: dict[int, int] = {}
            for row in part.select(F.col("query_id").cast("long").alias("query_id"), F.explode(query_terms("text")).alias("term")).distinct().withColumn("shard", self._shard()).collect():
                wanted.setdefault((row.term, row.shard), []).append(names.setdefault(row.query_id, len(names)))
            terms = F.broadcast(self.spark.createDataFrame([(t, s, i) for i, (t, s) in enumerate(wanted)], "term string, shard int, i int"))
            near = F.col("shard").isin(sorted({s for _, s in wanted})) if wanted else F.lit(False)
            counts = self.parts.read("counts", _COUNTS).where(near).join(terms, ["term", "shard"]).groupBy("i").agg(F.sum("n").alias("n"))
            df = np.zeros(len(wanted))
            for r in counts.collect():
                df[r.i] = r.n
            idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6)
            first = np.cumsum([0, *map(len, wanted.values())])
            shared = self.spark.sparkContext.broadcast((list(names), first, np.array(sum(wanted.values(), []), np.int64), idf))
            columns = ["batch", "window", "i", "ids", "tfs", "dls", "most", "least"]
            lists = self.parts.read("postings", _POSTINGS).where(near).join(terms, ["term", "shard"]).select(*columns)
            none = F.expr("cast(array() as array<int>)")
            gone = self.parts.read("gone", _GONE).groupBy("of", "window").agg(F.collect_list("id").alias("ids"))
            gone = gone.select(F.col("of").alias("batch"), "window", F.lit(-1).alias("i"), "ids", none.alias("tfs"), none.alias("dls"), F.lit(0).alias("most"), F.lit(0).alias("least"))
            dealt = lists.union(gone).repartition("batch", "window").sortWithinPartitions("batch", "window", "i")
            some = dealt.mapInArrow(scored(shared, k, avgdl), "query_id long, id long, score double")
            out = some if out is None else out.union(some)
        return top(out.withColumnRenamed("id", "doc_id"), "query_id", F.round("score", 9), "doc_id", k)
