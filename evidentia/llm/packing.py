"""Packing tokenised documents into sequences of at most `capacity` tokens.

Documents become pieces of `capacity` tokens and a rest. Documents are dealt to randomised groups of about
`group_documents`, by a hash of the number that each row got when it was tokenised, so that rows of one id, or of none,
spread like any others. Within a group the bins are filled by first-fit decreasing: full pieces take a bin each as they
come, and the rests, at most one a document, go by falling length to the leftmost bin with room, which a tournament tree
over the bins' room finds in logarithmic time. A task holds the rests of one group; each group leaves a few bins half
full, some 0.1 % of its tokens.

Null and empty texts are the single end token. A null id, or one that several rows have, is packed once for each row.
Texts of any length are packed whole. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut, eights, lowered, mix, text_slices

CAPACITY, END_ID = 4096, 2
_SPACE, _LETTER, _DIGIT, _PUNCT, _QUOTE, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[:0x80] = _PUNCT
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]] = _OTHER
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27] = _QUOTE
#: Whether a piece may begin between a byte of one kind and one of the other.
_CUT = np.zeros((6, 6), bool)
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _PUNCT), (_DIGIT, _PUNCT)):
    _CUT[_a, _b] = _CUT[_b, _a] = True
_CUT[_SPACE, :] = _CUT[_LETTER, _QUOTE] = _CUT[_DIGIT, _QUOTE] = True


class WordTokenizer:
    """Ids of whole texts by a word-level tokenizer file, from a table of pieces already seen.

    The tokenizer lower-cases, drops white space and never joins letters, digits and punctuation, so a text's ids are
    those of its stretches between white space and between ASCII letters, digits and punctuation. A stretch is not cut
    beside an apostrophe (but after a letter or digit, where a contraction may begin) nor beside a non-ASCII byte. Texts
    with "<|" (special tokens) go to the tokenizer whole. The table has 2**bits places, each for the last piece of up to
    SHORT bytes that fell there, with its bytes, so that a hit is an equal piece; longer ones up to LONG bytes are keys
    of a dictionary. Both are emptied when their ids exceed `most`.
    """

    SHORT, LONG = 16, 256

    def __init__(self, path: str, bits: int = 21, most: int = 6_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.shift, self.most = Tokenizer.from_file(path), np.uint64(64 - bits), most
        ends = {i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")}
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.last[list(ends)] = True
        self.head, self.tail, self.width = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint8)
        self.origin, self.size = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each piece. Words of letters only are encoded in runs, which the ids that end a word part."""
        out: list[np.ndarray | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        for i in range(0, len(plain), 500):
            run = plain[i : i + 500]
            ids = self._encode(" ".join(words[j] for j in run))
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(run) and stops[-1] == len(ids):
                for j, part in zip(run, np.split(ids, stops[:-1]), strict=True):
                    out[j] = part
        return [self._encode(w) if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def _look_up(self, low: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids begin in self.flat, and how many they are."""
        if len(self.flat) > self.most:
            self.width[:] = 0
            self.long.clear()
            self.flat = np.zeros(0, np.uint32)
        width = ends - starts
        head, tail = eights(low, starts, width), eights(low, np.minimum(starts + 8, len(raw)), np.maximum(width - 8, 0))
        slot = (mix(head ^ mix(tail + width.astype(np.uint64))) >> self.shift).astype(np.int64)
        origin, size = self.origin[slot], self.size[slot]
        miss = np.flatnonzero((self.width[slot] != width) | (self.head[slot] != head) | (self.tail[slot] != tail) | (width > self.SHORT))
        if len(miss):
            folded, fresh, new, back = low.tobytes(), {}, [], []
            for i, a, b in zip(miss.tolist(), starts[miss].tolist(), ends[miss].tolist(), strict=True):
                piece = folded[a:b]
                if known := self.long.get(piece):
                    origin[i], size[i] = known
                    continue
                if piece not in fresh:
                    fresh[piece] = len(new)
                    new.append(i)
                back.append((i, fresh[piece]))
            if new:
                made = self._pieces([raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
                sizes = np.fromiter(map(len, made), np.int32, len(made))
                origins = (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32)
                self.flat = np.concatenate([self.flat, *made])
                at, which = np.array(back).T
                origin[at], size[at] = origins[which], sizes[which]
                for piece, o, n in zip(fresh, origins.tolist(), sizes.tolist(), strict=True):
                    if self.SHORT < len(piece) <= self.LONG:
                        self.long[piece] = o, n
                short = width[new] <= self.SHORT
                put = slot[new][short]
                self.head[put], self.tail[put], self.width[put] = head[new][short], tail[new][short], width[new][short]
                self.origin[put], self.size[put] = origins[short], sizes[short]
        return origin, size

    def ids(self, column) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow column; nulls have none."""
        for first, last, data, rows in text_slices(column):
            if not len(data):
                yield from (np.zeros(0, np.uint32) for _ in range(last - first))
                continue
            kind = _KIND[data]
            before = np.empty_like(kind)
            before[0] = _SPACE
            before[1:] = kind[:-1]
            begins = _CUT[before, kind]
            begins[rows[:-1][rows[:-1] < len(data)]] = True
            begins &= kind != _SPACE
            starts = np.flatnonzero(begins)
            closes = np.ones(len(data), bool)
            closes[:-1] = begins[1:] | (kind[1:] == _SPACE)
            closes[rows[rows > 0] - 1] = True
            ends = np.flatnonzero((kind != _SPACE) & closes) + 1
            raw = data.tobytes()
            origin, size = self._look_up(lowered(data), raw, starts, ends)
            done = np.cumsum(size, dtype=np.int64)
            ids = self.flat[np.repeat(origin - (done - size), size) + np.arange(done[-1] if len(done) else 0)]
            token_at = np.concatenate([[0], done])[np.searchsorted(starts, rows)]
            special = b"<|" in raw
            for i in range(last - first):
                if special and b"<|" in (text := raw[rows[i] : rows[i + 1]]):
                    yield self._encode(text.decode())
                else:
                    yield ids[token_at[i] : token_at[i + 1]]


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each item: items by falling length (ties in order), each in the leftmost bin with room.

    The tree's leaves are the bins' room; a node holds the most room below it.
    """
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    tree = [capacity] * (2 * size)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, node = lengths[i], 1
        if need > capacity:
            raise ValueError(f"an item of {need} does not fit in {capacity}")
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        out[i] = node - size, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, row_no): documents' ids in stretches of capacity, the last one shorter.

    row_no tells the rows of docs apart; it is that of this run only, so the result is to be written before use.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_no"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, row_no = _tokenizer(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.ids(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                out.extend((doc_id, i, len(part := ids[i : i + capacity]), zlib.crc32(part.tobytes()), len(ids), row_no) for i in range(0, len(ids), capacity))
                row_no += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(split, ", ".join(f"{n} long" for n in names))


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_documents: int = 4000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece.

    sequence_id is the group's number times 2**32 plus the bin's number in it.
    """
    cutup = cut(pieces(docs, tokenizer_path, capacity, end_id))
    groups = max(1, -(-cutup.where("start = 0").count() // group_documents))
    placed = cutup.withColumn("g", F.pmod(F.xxhash64("row_no", F.lit(11)), F.lit(groups))).drop("row_no")
    names = [*placed.columns[:-1], "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by group; a group may go on in the next batch."""
        group, full, rests, out = None, 0, [], []

        def close() -> None:
            for row, (b, offset) in zip(rests, first_fit_decreasing([r[2] for r in rests], capacity), strict=True):
                out.append((*row[:5], (group << 32) + full + b, offset))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[5] != group:
                    close()
                    group, full, rests = row[5], 0, []
                if row[2] == capacity:
                    out.append((*row[:5], (group << 32) + full, 0))
                    full += 1
                else:
                    rests.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return placed.repartition("g").sortWithinPartitions("g", "doc_id", "start", "ids_crc32").mapInArrow(pack, ", ".join(f"{n} long" for n in names))
