"""Shared pieces of the training-data operators: lineage cuts and vectorised text helpers.

Text helpers work on the byte buffers of Arrow string columns, in slices of bounded size, so
that a task's memory follows the longest single text and not the batch.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir; where unset, a fresh one, in local mode only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="evidentia-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widened(df: DataFrame, **kinds: str) -> T.StructType:
    """df's schema with more fields."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, T.LongType() if kind == "long" else T.DoubleType() if kind == "double" else T.StringType()) for name, kind in kinds.items())])


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def fold_of_py(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def byte_class(pattern_bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


#: Bytes of words split by white space: everything but space and \t..\r.
NON_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Bytes of words of letters and digits: ASCII alphanumerics and every non-ASCII byte.
WORD = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])

#: A-Z as a-z, and every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The bytes of the first 0 to 8 of eight little-endian ones.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Spans over so many bytes are hashed one by one.
LONG_SPAN = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets in them) of a string or binary column; nulls are empty.

    A slice holds about `limit` bytes, or one longer text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, rows: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of concatenated texts, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    m = is_word[data]
    edge = rows[(rows > 0) & (rows < len(data))]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    before[edge] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, rows)


def lowered(data: np.ndarray) -> np.ndarray:
    """data with A-Z as a-z, and eight zero bytes behind."""
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = LOWER[data]
    return low


def eights(low: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The up to eight bytes from each place of what `lowered` gives, as a number; left: how many bytes count."""
    every = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    return every[at] & _FIRST[np.minimum(left, 8)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, blind to the case of A-Z.

    Eight bytes at a time are mixed in, so that no linear relation between bytes carries over; spans over LONG_SPAN
    bytes take a cryptographic hash each.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    low, size = lowered(data), ends - starts
    out = mix(size.astype(np.uint64) * _BASE)
    out = mix(out ^ eights(low, starts, size))
    rest = np.flatnonzero(size > 8)
    for done in range(8, LONG_SPAN, 8):
        if not len(rest):
            break
        out[rest] = mix(out[rest] * _BASE ^ eights(low, starts[rest] + done, size[rest] - done))
        rest = rest[size[rest] > done + 8]
    for i in rest.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one word sequence; a shorter one gives one hash of all of it, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, k)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * _BASE + words[i : n - size + 1 + i])
    return out
