"""Quality scores: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its distinct words (hashed, of one length together), binned statistics of its structure (shares of
capitals, digits, marks, white space, repeats and so on) and its binned size. The pairwise interactions have low rank
RANK and are summed in linear time: half of (sum of v x) squared less the sum of (v x) squared.

The fit takes a bounded sample of the labelled documents (`max_rows`, the smallest hashes of the id; of these the first
whose features keep to FIT_FEATURES) in one task; features are found before, in parallel. Its result, `2**BITS` rows of
RANK + 1 numbers, has a fixed size and is broadcast. Null and empty texts have the statistics of an empty text. Whole
texts of any length are scored. Rows of null labels or ids are not learnt from; with one class only, every score is its
smoothed share. Of rows that repeat an id one is learnt from (the least hash of the text), and each is scored. An empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NON_SPACE, span_hashes, text_slices, word_spans
from .toxicity import labelled_sample

BITS, RANK, BINS = 17, 6, 12
#: Features that the fit holds at most, over all documents.
FIT_FEATURES = 50_000_000
#: Places kept for statistics: STATS of them times BINS.
STATS = 14
WORDS_FROM = STATS * BINS
_CLASS = np.zeros(256, np.uint8)
for _i, _bytes in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), range(0x80, 0x100), [0x20, 9, 11, 12, 13], [10], b"*$%&#@^~", b"!?", b"|", b".,;:", b"()[]{}<>=+/\\_-\"'`"), 1):
    _CLASS[list(_bytes)] = _i


def statistics(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """STATS numbers from 0 to 1 of a text's bytes and word hashes."""
    n, m = max(1, len(text)), max(1, len(words))
    share = np.bincount(_CLASS[text], minlength=12)[:12] / n
    distinct = len(np.unique(words)) / m
    repeats = float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0
    return np.array([*share[1:12], distinct, repeats, min(1.0, np.log1p(len(text)) / 14)])


def features(text: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features."""
    s = np.minimum(np.ceil(np.sqrt(statistics(text, words)) * (BINS - 1)), BINS - 1).astype(np.int64)
    at = np.unique(WORDS_FROM + (words % np.uint64((1 << BITS) - WORDS_FROM)).astype(np.int64))
    return np.concatenate([np.arange(STATS) * BINS + s, at]), np.concatenate([np.ones(STATS), np.full(len(at), 1 / np.sqrt(max(1, len(at))))])


def raw_score(model: tuple, at: np.ndarray, x: np.ndarray) -> float:
    bias, w, v = model
    vx = v[at] * x[:, None]
    return float(bias + w[at] @ x + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx * vx).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int = 6, seed: int = 3) -> tuple:
    """(bias, weights, factors) by stochastic gradients with step sizes of their own (Adagrad)."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    w, v = np.zeros(1 << BITS), rng.normal(0, 0.02, (1 << BITS, RANK))
    if not 0 < y.sum() < len(y):
        return bias, w, np.zeros_like(v)
    gw2, gv2 = np.full(1 << BITS, 1e-3), np.full((1 << BITS, RANK), 1e-3)
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            at, x = rows[i]
            vx = v[at] * x[:, None]
            total = vx.sum(axis=0)
            z = bias + w[at] @ x + 0.5 * ((total**2).sum() - (vx * vx).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            if abs(g) < 1e-3:
                continue
            gw = g * x + 1e-5 * w[at]
            gv = g * (x[:, None] * (total - vx)) + 1e-4 * v[at]
            gw2[at] += gw * gw
            gv2[at] += gv * gv
            w[at] -= 0.1 * gw / np.sqrt(gw2[at])
            v[at] -= 0.03 * gv / np.sqrt(gv2[at])
            bias -= 0.01 * g
    return bias, w, v


def _rows(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for first, last, data, rows in text_slices(column):
        starts, ends, first_word = word_spans(data, rows, NON_SPACE)
        words = span_hashes(data, starts, ends)
        for i in range(last - first):
            yield features(data[rows[i] : rows[i + 1]], words[first_word[i] : first_word[i + 1]])


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(_rows(batch.column(0)))
        places, values = (pa.array([part[side].astype(kind).tobytes() for part in found], pa.binary()) for side, kind in ((0, "<i4"), (1, "<f4")))
        yield pa.RecordBatch.from_arrays([places, values, batch.column(1), batch.column(2)], names=["places", "vals", "y", "h"])


def _fitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, y, held = [], [], 0
    for batch in batches:
        for places, values, label in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
            at = np.frombuffer(places.as_py(), "<i4")
            held += len(at)
            if held <= FIT_FEATURES:
                rows.append((at, np.frombuffer(values.as_py(), "<f4")))
                y.append(label)
    bias, w, v = fit(rows, np.array(y, np.float64))
    yield pa.RecordBatch.from_arrays([pa.array([float(bias)]), pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([v.astype("<f4").tobytes()], pa.binary())], names=["bias", "w", "v"])


def quality(docs: DataFrame, labels: DataFrame, where=None, max_rows: int = 12_000) -> DataFrame:
    """(doc_id, score) of each document's whole text; `where` picks the labelled rows that may be learnt from."""
    sample = labelled_sample(docs, labels, "quality", max_rows, where).select("text", F.col("y").cast("long"), F.xxhash64("doc_id").alias("h"))
    found = sample.mapInArrow(_featurer, "places binary, vals binary, y long, h long")
    row = found.repartition(1).sortWithinPartitions("h").mapInArrow(_fitter, "bias double, w binary, v binary").first()
    model = (0.0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, RANK), np.float32)) if row is None else (row["bias"], np.frombuffer(row["w"], "<f4"), np.frombuffer(row["v"], "<f4").reshape(-1, RANK))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            z = np.array([raw_score(held, *row) for row in _rows(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double")
