"""MinHash near-duplicate grouping with min-max hashing.

Under each of `perms` permutations both the least and the greatest hash of a document's shingle set are kept, so half
as many hash evaluations make a signature of the same length and variance as one of plain minima. Each band joins two
minima and two maxima of four different permutations. Documents with equal sets are one class, known by a number of its
own and shown by one of its rows; only that goes on. In a bucket every class is checked against the bucket's first (its
pivot) on full sets; these links, over all buckets, give first components. Where a pivot's classes still lie in several of
them, those apart from the pivot are settled against all of the pivot's: what each adds to and drops from the pivot's set
gives the exact overlap of two. Such checks run in blocks, skip what is in one component already, and return the links
that join two. A task holds one side of a block, bounded by rows and by bytes, and streams the other.

Nulls, empty texts and texts without words have an empty set: size 0, linked with nothing, their own component. A null
id has a null component and counts as kept. Rows that repeat an id give a row each, and each row's text is compared with
all others. Texts of any length count whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NON_SPACE, cut, mix, shingle_hashes, span_hashes, text_slices, word_spans
from .graph import components

#: Least and greatest number of rows of either side of a block of pairs, and the number of blocks a side between: so a
#: row is copied at most BLOCKS times in groups of up to BLOCKS * MOST_BLOCK rows.
BLOCK, MOST_BLOCK, BLOCKS = 256, 16_384, 64
#: Bytes of the differences that the held side of a block has, on average.
BLOCK_BYTES = 64 << 20


def _permutations(perms: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**32, perms, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, perms, dtype=np.uint32)


def min_max(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest value of a set of shingle hashes under each permutation."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(a), 2**32 - 1, np.uint32), np.zeros(len(a), np.uint32)
    for i in range(0, len(x), 4096):
        h = np.multiply.outer(a, x[i : i + 4096])
        h += b[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return low, high


def band_hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One hash for each two permutations: their minima with the next two's maxima. low, high: (documents, permutations)."""
    bands = low.shape[1] // 2
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(low), 1))
    for part in (low[:, 0::2], low[:, 1::2], np.roll(high, -2, axis=1)[:, 0::2], np.roll(high, -2, axis=1)[:, 1::2]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
    return out


def _sets(column, k: int, is_word: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for first, last, data, rows in text_slices(column):
        starts, ends, first_word = word_spans(data, rows, is_word)
        words = span_hashes(data, starts, ends)
        for i in range(last - first):
            yield np.unique(shingle_hashes(words[first_word[i] : first_word[i + 1]], k))


def _signer(k: int, perms: int, is_word: np.ndarray):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(perms)
        for batch in batches:
            n = batch.num_rows
            sizes, d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            low, high = np.zeros((n, perms), np.uint32), np.zeros((n, perms), np.uint32)
            for i, s in enumerate(_sets(batch.column(1), k, is_word)):
                sizes[i] = len(s)
                if len(s):
                    d1[i], d2[i] = s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)
                    low[i], high[i] = min_max(s, a, b)
            bands = pa.array(band_hashes(low, high).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (perms // 2)), bands)],
                names=["id", "shown", "n", "d1", "d2", "bands"],
            )

    return sign


_PAIR = "x long, p long, nx int, np int, ix int, linked boolean, added binary, dropped binary"


def _verifier(k: int, num: int, den: int, is_word: np.ndarray):
    schema = pa.schema([("x", pa.int64()), ("p", pa.int64()), ("nx", pa.int32()), ("np", pa.int32()), ("ix", pa.int32()), ("linked", pa.bool_()), ("added", pa.binary()), ("dropped", pa.binary())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, None
        for batch in batches:
            xs, ps, texts, pivots = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            for lo in range(0, len(xs), 256):
                out = []
                for i, s in zip(range(lo, lo + 256), _sets(texts.slice(lo, 256), k, is_word), strict=False):
                    if ps[i] != known:
                        known, own = ps[i], next(_sets(pivots.slice(i, 1), k, is_word))
                    added, dropped = np.setdiff1d(s, own, assume_unique=True), np.setdiff1d(own, s, assume_unique=True)
                    both = len(s) - len(added)
                    linked = both * (den + num) >= num * (len(s) + len(own))
                    out.append((xs[i], ps[i], len(s), len(own), both, linked, added.tobytes(), dropped.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return verify


class _Block:
    """One side of a block of one pivot's classes, in memory, against which the rows of the other are settled.

    A row: number, size, overlap with the pivot, its size, component, added, dropped. A pair that earlier links join is not
    looked at again, so a block gives fewer links than it has rows.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den, self.rows, self.home, self.ready = num, den, [], {}, False

    def root(self, node: int) -> int:
        home = self.home
        home.setdefault(node, node)
        while home[node] != node:
            home[node] = node = home[home[node]]
        return node

    def _index(self) -> None:
        added = np.concatenate([r[5] for r in self.rows])
        owner = np.repeat(np.arange(len(self.rows)), [len(r[5]) for r in self.rows])
        order = np.argsort(added, kind="stable")
        self.added, self.owner = added[order], owner[order]
        self.size, self.both = (np.array([r[c] for r in self.rows], np.int64) for c in (1, 2))
        self.ready = True

    def links(self, r: tuple) -> Iterator[tuple[int, int]]:
        """The links of one row of the other side that join what is apart."""
        if not self.rows:
            return
        if not self.ready:
            self._index()
        left = np.searchsorted(self.added, r[5], "left")
        count = np.searchsorted(self.added, r[5], "right") - left
        hit = np.flatnonzero(count)
        at = (np.repeat(left[hit] - np.cumsum(count[hit]) + count[hit], count[hit]) + np.arange(count[hit].sum())).astype(np.int64)
        shared = np.bincount(self.owner[at], minlength=len(self.rows))
        for j in np.flatnonzero((np.minimum(self.both, r[2]) + shared) * (self.den + self.num) >= self.num * (self.size + r[1])):
            o = self.rows[j]
            mine, other = self.root(r[4]), self.root(o[4])
            if mine == other:
                continue
            both = r[3] - len(r[6]) - len(o[6]) + len(np.intersect1d(r[6], o[6], assume_unique=True)) + int(shared[j])
            if both * (self.den + self.num) >= self.num * (r[1] + o[1]):
                self.home[mine] = other
                yield r[0], o[0]


def _settler(num: int, den: int):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by block, the held side first; a block may go on in the next batch."""
        key, block = None, None
        for batch in batches:
            c, out = {name: batch.column(name).to_pylist() for name in batch.schema.names if name not in ("added", "dropped")}, []
            added, dropped = batch.column("added"), batch.column("dropped")
            for i in range(batch.num_rows):
                now = c["p"][i], c["u"][i], c["v"][i]
                if now != key:
                    key, block = now, _Block(num, den)
                row = (c["x"][i], c["nx"][i], c["ix"][i], c["np"][i], c["home"][i], *(np.frombuffer(d[i].as_py(), np.uint64) for d in (added, dropped)))
                if c["side"][i] == 0:
                    block.rows.append(row)
                else:
                    out.extend(block.links(row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*out, strict=True)], names=["a", "b"])

    return settle


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: tuple[int, int] = (80, 100), perms: int = 64, id_col: str = "doc_id", text_col: str = "text", is_word: np.ndarray = NON_SPACE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    similarity: numerator and denominator of the least Jaccard similarity that links. With 64 permutations, so 32 bands
    of four values, a pair at 0.8 is missed with probability 5e-8.
    """
    num, den = similarity
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("shown", F.xxhash64("text"))
    signed = cut(base.mapInArrow(_signer(shingle_words, perms, is_word), "id long, shown long, n long, d1 long, d2 long, bands array<long>"))
    # A class is shown by the row of its least id and text hash, and numbered as it is written.
    classes = signed.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min(F.struct("id", "shown")).alias("r"), F.first("bands").alias("bands"))
    classes = cut(classes.select("d1", "d2", "r.id", "r.shown", "bands", F.monotonically_increasing_id().alias("key")))

    placed = classes.select("key", F.explode("bands").alias("bucket"))
    pivots = placed.groupBy("bucket").agg(F.min("key").alias("p"), F.count("*").alias("size")).where("size > 1").select("bucket", "p")
    stars = cut(placed.join(pivots, "bucket").where("key != p").select(F.col("key").alias("x"), "p").distinct())

    needed = stars.select(F.col("x").alias("key")).union(stars.select(F.col("p").alias("key"))).distinct()
    named = classes.select("key", "id", "shown").join(needed, "key", "left_semi")
    # Both sides grow with the input, so neither is ever sent whole to the tasks.
    # Rows lie by (id, shown) after the join, and are grouped there: texts move once.
    texts = cut(base.join(named.hint("merge"), ["id", "shown"]).groupBy("id", "shown", "key").agg(F.min("text").alias("text")).select("key", "text"))
    pairs = stars.join(texts.select(F.col("key").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("key").alias("p"), F.col("text").alias("tp")), "p")
    checked = cut(pairs.select("x", "p", "tx", "tp").mapInArrow(_verifier(shingle_words, num, den, is_word), _PAIR))

    linked = checked.where("linked").select(F.col("x").alias("a"), F.col("p").alias("b"))
    first = cut(components(linked))
    at_home = lambda key, home: first.select(F.col("id").alias(key), F.col("component_id").alias(home))
    placed = checked.select("x", "p", (F.octet_length("added") + F.octet_length("dropped")).alias("bytes")).join(at_home("x", "hx"), "x", "left").join(at_home("p", "hp"), "p", "left")
    placed = placed.select("x", "p", "bytes", F.coalesce("hx", "x").alias("home"), (F.coalesce("hx", "x") != F.coalesce("hp", "p")).alias("apart"))
    edge = lambda n: F.least(F.greatest(F.ceil(n / BLOCKS), F.lit(BLOCK)), F.lit(MOST_BLOCK))
    apart = lambda c: F.when(F.col("apart"), c)
    load = placed.groupBy("p").agg(F.count("*").alias("m"), F.count(apart(1)).alias("s"), F.coalesce(F.sum(apart(F.col("bytes"))), F.lit(0)).alias("b")).where("m > 1 and s > 0")
    load = load.select("p", F.greatest(F.ceil(F.col("s") / edge(F.col("s"))), F.ceil(F.col("b") / BLOCK_BYTES)).alias("us"), F.ceil(F.col("m") / edge(F.col("m"))).alias("vs"))
    held = checked.drop("linked").join(placed.drop("bytes").join(load, "p"), ["x", "p"])
    block = lambda n, salt: F.pmod(F.xxhash64("x", F.lit(salt)), F.col(n))
    every = lambda n, make: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), make)
    cell = lambda u, v, side: F.struct(u.alias("u"), v.alias("v"), F.lit(side).alias("side"))
    left = F.when(F.col("apart"), every("vs", lambda v: cell(block("us", 0), v, 0)))
    cells = held.withColumn("cell", F.explode(F.concat(F.coalesce(left, F.array()), every("us", lambda u: cell(u, block("vs", 1), 1)))))
    cells = cells.select("p", "cell.u", "cell.v", "cell.side", "x", "nx", "np", "ix", "home", "added", "dropped")
    links = cells.repartition("p", "u", "v").sortWithinPartitions("p", "u", "v", "side").mapInArrow(_settler(num, den), "a long, b long")

    # What the first components join counts as edges to their first members; the links join these. The least id of a
    # component is looked for among the classes that have a link only.
    found = cut(components(first.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(links)))
    found = found.select(F.col("id").alias("key"), F.col("component_id").alias("c"))
    found = found.union(found.select("c", "c")).distinct().join(classes.select("key", "id"), "key")
    found = found.join(found.groupBy("c").agg(F.min("id").alias("home")), "c").select("key", "home")
    home = classes.select("key", "d1", "d2", "id").join(found, "key", "left").select("d1", "d2", F.coalesce("home", "id").alias("home"))
    out = signed.select("id", "n", "d1", "d2").join(home, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("home")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
