"""A stored vector index: inverted files of coarse k-means cells, probed by partition, kept up by batches of changes.

Centroids are fitted by Spark's k-means on unit vectors, of at most about `sample` vectors picked by a hash of their ids; every
vector is indexed, in the `cell` folder of its nearest centroid (of as many files as the cell has multiples of WRITTEN
rows, so that a cell which holds a third of all is written by many tasks). A query looks at the folders of its `probes`
nearest cells only and scores what lies there exactly, by cosine; with all cells it finds what `retrieval.neighbours` does.

How many cells to look at depends on the vectors: `probes_for` measures it for a target recall. Vectors without any structure
have their neighbours in most cells.

Changes keep the centroids: a batch lists the versions it retires in `gone`, and adds its vectors to their cells. `rebuild`
fits anew. Ids are whole numbers; null ids, null, zero or not finite vectors, and those of another dimension than the
centroids (the longest of the sample's) are not indexed. Of rows that repeat an id in a batch the greatest vector counts,
and if one of them is forgotten, the id is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .parts import Parts
from .retrieval import VECTOR_BYTES, Best, _batches, _blocks, top

#: Vectors that centroids are fitted on, most cells (their centroids go to every task), and rows of a cell in one file.
SAMPLE, MOST_CELLS, WRITTEN = 100_000, 4096, 1 << 18
_VECTORS = "id long, vector array<double>, cell int"
_GONE = "id long, of int"
_CENTROIDS = "cell int, centroid array<double>"


def _usable(vector: Column) -> Column:
    """A vector that has a direction."""
    length = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    return (F.size(vector) > 0) & (length > 0) & (length < float("inf"))


def _unit(vector: Column) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: x / length)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Cells:
    """The index below `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.parts = spark, Parts(spark, root)

    def centroids(self) -> np.ndarray:
        """(cells, dimensions); as many rows as MOST_CELLS at most."""
        rows = sorted(self.parts.read("centroids", _CENTROIDS).collect(), key=lambda r: r.cell)
        return np.array([r.centroid for r in rows], np.float64).reshape(len(rows), -1)

    def _rows(self, vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return rows.where("id is not null")

    def _write(self, batch: int, rows: DataFrame, centroids: np.ndarray, base: bool, **figures: float) -> None:
        """Adds rows (id, vector), one an id, to the cells of their nearest centroids, and commits."""
        shared, width = self.spark.sparkContext.broadcast(centroids), centroids.shape[1]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in batches:
                m = _matrix(held.column(1), width) if held.num_rows else np.zeros((0, width))
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
                cell = np.concatenate([(m[i : i + 4096] @ shared.value.T).argmax(axis=1) for i in range(0, len(m), 4096)] or [np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array(cell, pa.int32())], names=["id", "vector", "cell"])

        placed = rows.where((F.size("vector") == width) & _usable(F.col("vector"))).mapInArrow(assign, _VECTORS)
        # As many rows as cells at most, so a table of them goes to every task.
        load = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / WRITTEN).alias("files")))
        dealt = placed.join(load, "cell").repartition("cell", F.pmod(F.xxhash64("id"), "files")).drop("files")
        self.parts.write(dealt.select("id", "vector", "cell"), "vectors", batch, "cell")
        self.parts.commit(batch, base, **figures)

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, sample: int = SAMPLE, seed: int = 0) -> "Cells":
        """A new index of vectors in place of what there was; cells: by default the square root of their number."""
        rows = self._rows(vectors, id_col, vector_col).groupBy("id").agg(F.max("vector").alias("vector"))
        able = rows.where(_usable(F.col("vector")))
        shape = able.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
        batch = self.parts.next_batch()
        if not shape.n:
            raise ValueError("no vectors to fit cells on")
        some = able.where((F.pmod(F.xxhash64("id"), F.lit(-(-shape.n // sample))) == 0) & (F.size("vector") == shape.width))
        k = min(cells or max(2, round(shape.n**0.5)), MOST_CELLS)
        unit = some.orderBy("id").select(array_to_vector(_unit(F.col("vector"))).alias("features"))
        found = np.array(KMeans(k=k, seed=seed, maxIter=10).fit(unit).clusterCenters())
        found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
        held = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], _CENTROIDS)
        self.parts.write(held.coalesce(1), "centroids", batch)
        self._write(batch, able, found, True)
        return self

    def live(self) -> DataFrame:
        """Each indexed vector: (id, vector, cell, batch)."""
        gone = self.parts.read("gone", _GONE).select("id", F.col("of").alias("batch"))
        return self.parts.read("vectors", _VECTORS).join(gone, ["id", "batch"], "left_anti")

    def change(self, changes: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", forgotten_col: str = "forgotten") -> "Cells":
        """Applies one batch of new, changed and forgotten vectors (id, vector, forgotten), retirements first."""
        batch = self.parts.next_batch()
        rows = self._rows(changes.withColumn("__gone", F.coalesce(F.col(forgotten_col), F.lit(False))), id_col, vector_col)
        marks = changes.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(forgotten_col), F.lit(False)).alias("gone")).where("id is not null").groupBy("id").agg(F.max("gone").alias("gone"))
        retired = self.live().select("id", F.col("batch").alias("of")).join(marks.select("id"), "id", "left_semi")
        self.parts.write(retired, "gone", batch)
        new = rows.join(marks.where("gone"), "id", "left_anti").groupBy("id").agg(F.max("vector").alias("vector"))
        self._write(batch, new, self.centroids(), False)
        return self

    def rebuild(self, **options) -> "Cells":
        """Fits and writes anew what is live."""
        return self.build(self.live(), "id", "vector", **options)

    def probed(self, asked: np.ndarray, probes: int) -> np.ndarray:
        """The `probes` nearest cells of each unit vector asked, (queries, probes)."""
        near = asked @ self.centroids().T
        return np.argsort(-near, axis=1, kind="stable")[:, :probes]

    def probes_for(self, target: float, k: int, sample: int = 256) -> int:
        """The least number of probes by which `target` of the k nearest of about `sample` stored vectors, picked by a hash
        of their ids, are found: measured on an exact search for these. Their k neighbours each come to the driver.
        """
        held = self.live()
        some = held.where(F.pmod(F.xxhash64("id", F.lit("probe")), F.lit(-(-held.count() // sample))) == 0).select(F.col("id").alias("query_id"), "vector")
        rows = some.collect()
        near = self.probed(np.array([np.array(r.vector) / np.linalg.norm(r.vector) for r in rows]), MOST_CELLS)
        place = dict(zip([r.query_id for r in rows], near.argsort(axis=1), strict=True))
        found = self.search(some, k).select("query_id", "id").join(held.select("id", "cell"), "id").collect()
        needed = sorted(int(place[r.query_id][r.cell]) + 1 for r in found)
        return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] if needed else 1

    def search(self, queries: DataFrame, k: int, probes: int | None = None, floor: float | None = None, same: bool = False, only: DataFrame | None = None) -> DataFrame:
        """(query_id, id, similarity, rank): the k nearest of those in the `probes` nearest cells (null: all) of each query
        (query_id, vector); with `only`, of those whose id it lists.
        """
        out, width = None, self.centroids().shape[1]
        stored = self.live()
        if only is not None:
            stored = stored.join(only.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
        numbered = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("vector")).where("query_id is not null")
        numbered = numbered.where((F.size("vector") == width) & _usable(F.col("vector")))
        for rows in _blocks(numbered, max(1, VECTOR_BYTES // (8 * width))):
            rows = rows.collect()
            names = np.array([r.query_id for r in rows], np.int64)
            asked = np.array([r.vector for r in rows], np.float64).reshape(len(rows), width)
            asked /= np.linalg.norm(asked, axis=1, keepdims=True)
            near = self.probed(asked, probes or MOST_CELLS)
            # Of each cell, the queries that look at it.
            order = np.argsort(near, axis=None, kind="stable")
            cells, begin = np.unique(near.ravel()[order], return_index=True)
            by_cell = dict(zip(cells.tolist(), np.split(order // max(1, near.shape[1]), begin[1:]), strict=False)) if len(rows) else {}
            shared = self.spark.sparkContext.broadcast((names, asked, by_cell))

            def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                names, asked, by_cell = shared.value
                best = Best(len(names), k)
                for held in batches:
                    cell = held.column(2).to_numpy()
                    for c in np.unique(cell).tolist():
                        part = held.filter(pa.array(cell == c))
                        who = np.sort(by_cell[c])
                        step = max(1, (1 << 22) // len(who))
                        for lo in range(0, part.num_rows, step):
                            some = part.slice(lo, step)
                            m, ids = _matrix(some.column(1), width), some.column(0).to_numpy()
                            similarity = asked[who] @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
                            fit = np.isfinite(similarity) if floor is None else similarity >= floor
                            if not same:
                                fit &= names[who][:, None] != ids
                            best.add(ids, np.where(fit, similarity, -np.inf), who)
                yield from _batches(best, names.tolist(), pa.int64(), pa.int64(), "similarity")

            part = stored.where(F.col("cell").isin(cells.tolist())).select("id", "vector", "cell").mapInArrow(scan, "query_id long, id long, similarity double")
            out = part if out is None else out.union(part)
        return top(out, "query_id", F.round("similarity", 9), "id", k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, wanted, hits): how many of the exact neighbours (query_id, id) of each query were found."""
    hits = exact.join(found.select("query_id", "id").withColumn("__hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("__hit").alias("hits"))
