"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct n-grams of 3 to 5 characters (code points, A-Z lower-cased), hashed. The ratio of an
n-gram is log((1 + positives with it) / (sum) : (1 + negatives with it) / (sum)); logistic regression runs on features
scaled by these ratios. The fit takes a bounded sample of the labelled documents (`max_rows`, the smallest hashes of the
id; of these the first whose features keep to FIT_FEATURES), in one task, which holds features and no texts. Its
result is `2**BITS` weights, a fixed size, which scoring tasks get as a broadcast.

Null and empty texts have no features and get the intercept's score. Whole texts of any length are scored. Rows of null
labels or ids are not learnt from. With no labelled rows, or of one class only, every score is the smoothed share of that
class. Of rows that repeat an id one is learnt from (the least hash of the text), and each is scored. An empty table
gives no rows. A column named tox_score is replaced; other extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, text_slices, widened

BITS = 18
GRAMS = (3, 4, 5)
#: An n-gram counts if its ratio is so many standard errors from 0.
SURE = 3.0
#: Features that the fit holds at most, over all documents.
FIT_FEATURES = 80_000_000
#: Characters that are looked at together.
BLOCK = 1 << 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def characters(text: np.ndarray) -> np.ndarray:
    """The code points of a text's UTF-8 bytes, A-Z lower-cased."""
    low = LOWER[text]
    if len(low) and low.max() >= 0x80:
        low = np.frombuffer(low.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    return low


def features(text: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of one text's bytes. mark: a scratch array of 2**BITS numbers."""
    c = characters(text)
    parts = [_grams(c[i : i + BLOCK + GRAMS[-1] - 1], mark) for i in range(0, max(1, len(c)), BLOCK)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _grams(c: np.ndarray, mark: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint64)
    grams, packed = [], c
    for n in range(2, GRAMS[-1] + 1):
        if len(c) < n:
            break
        packed = packed[:-1] * _MULTIPLY + c[n - 1 :]
        if n in GRAMS:
            grams.append((((packed + np.uint64(n)) * _MULTIPLY) >> np.uint64(64 - BITS)).astype(np.int64))
    if not grams:
        return np.zeros(0, np.int64)
    at = np.concatenate(grams)
    order = np.arange(len(at), dtype=np.int32)
    mark[at] = order
    return at[mark[at] == order]


def fit(found: list[np.ndarray], labels: np.ndarray, passes: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights by hashed n-gram, and the intercept; found: the features of each document."""
    y = np.asarray(labels, np.int64)
    counts = np.zeros((2, 1 << BITS))
    for f, label in zip(found, y, strict=True):
        counts[label, f] += 1
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not 0 < y.sum() < len(y):
        return np.zeros(1 << BITS, np.float32), prior
    rate = (counts + 1) / (np.array([[len(y) - y.sum()], [y.sum()]]) + 2)
    ratio = np.log(rate[1] / rate[0])
    ratio[np.abs(ratio) < SURE * np.sqrt((1 / (counts + 1)).sum(axis=0))] = 0
    found = [f[ratio[f] != 0] for f in found]
    w, squares, bias, rng = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), prior, np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            f = found[i]
            x = ratio[f]
            g = 1 / (1 + np.exp(-np.clip(bias + float(x @ w[f]), -30, 30))) - y[i]
            if abs(g) < 1e-3:
                continue
            step = g * x + 1e-5 * w[f]
            squares[f] += step * step
            w[f] -= 0.1 * step / np.sqrt(squares[f])
            bias -= 0.01 * g
    return (w * ratio).astype(np.float32), bias


def score(text: np.ndarray, weights: np.ndarray, bias: float, mark: np.ndarray) -> float:
    z = bias + float(weights[features(text, mark)].sum(dtype=np.float64))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, where=None) -> DataFrame:
    """(text, y, doc_id) of at most max_rows labelled documents, those with the smallest hashes of the id.

    1 counts where labels of an id differ; of texts of one id that of the least hash is taken, before the shuffle.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    if where is not None:
        known = known.where(where)
    ids = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(ids, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y")).select("text", "y", "doc_id")


def _fitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts come in the order of the sample; of each only the features are kept, until they are FIT_FEATURES."""
    mark = np.zeros(1 << BITS, np.int32)
    found, y, held = [], [], 0
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for first, last, data, rows in text_slices(batch.column(0)):
            for i in range(last - first):
                if held < FIT_FEATURES:
                    found.append(features(data[rows[i] : rows[i + 1]], mark).astype(np.int32))
                    y.append(labels[first + i])
                    held += len(found[-1])
    weights, bias = fit(found, np.array(y, np.int64)) if y else (np.zeros(1 << BITS, np.float32), 0.0)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 12_000, where=None) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample of labelled rows, in one task; `where` picks the rows that may be learnt from, by doc_id."""
    sample = labelled_sample(docs, labels, label, max_rows, where).select("text", F.col("y").cast("long"), F.xxhash64("doc_id").alias("h"))
    row = sample.repartition(1).sortWithinPartitions("h").mapInArrow(_fitter, "weights binary, bias double").first()
    if row is None:  # nothing is labelled, and Spark skips the task
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(row["weights"], np.float32), row["bias"]


def toxicity(docs: DataFrame, labels: DataFrame, where=None, max_rows: int = 12_000) -> DataFrame:
    """docs with a column score (0 to 1) of the whole text, `tox_score`; other columns pass through."""
    weights, bias = train(docs, labels, max_rows=max_rows, where=where)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        mark = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            out = [score(data[rows[i] : rows[i + 1]], w, b, mark) for first, last, data, rows in text_slices(batch.column("text")) for i in range(last - first)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "tox_score"])

    kept = docs.withColumn("text", F.col("text").cast("string")).drop("tox_score")
    return kept.mapInArrow(scorer, widened(kept, tox_score="double"))
