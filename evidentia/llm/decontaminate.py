"""Benchmark decontamination: CGK random-walk embeddings, bit-sampling LSH, exact edit verification.

Texts and benchmark items are word sequences (A-Z lower-cased, split at ASCII punctuation and white space). A document
holds an item if some stretch of it is within floor(EDITS * words of the item) word edits (insertion, deletion,
substitution) of the item. Every window of every whole text is looked at.

The allowed share of edits (EDITS) and the recall to be reached (TARGET) are parameters. An item of n words is split into
ceil((e + 1) / 2) parts, e = floor(EDITS * n), so that one part of any match has at
most one edit, however long the item. One edit leaves one half of a part as it is, so windows of a part's size in which
neither half of any part stands (in its place, or one word off) hold no such part; halves are looked up in a hash set.
The distinct parts, each once however many items have it, and the windows that are left are embedded by CGK walks: a
pointer reads the words one by one and moves on by a random bit of (step, word), so that edit distance becomes Hamming
distance. Each walk is sampled TABLES times at SAMPLED steps. A window that agrees with a part in any
sample and has all but one of its words makes a candidate. Around it, an edit spending at most one word, the item's own
words must stand often enough; then the exact edit distance to the whole item settles it.
The walks follow from the size of a part: so many that the worst place and kind of one edit is met with the recall
TARGET (`part_recall` measures it; WALKS holds the numbers for the parameters' defaults); a match of which several parts
have at most one edit has as many chances.

The benchmark is a stated query set: its index goes to each task, in blocks of about `max_items` items and `max_bytes`
bytes of text. Windows are looked at in blocks of a fixed number of words, so a task's memory follows the longest text
and the block and not the items' length. Each distinct (item_id, text) is an item of its own, so an id that stands for
several texts may give a document several rows, and items of a null id are found with a null item_id. Null or empty
texts hold nothing; items without words match nothing. Ties of place go to the earliest. Rows that repeat a doc_id give
repeated result rows. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD, mix, span_hashes, text_slices, word_spans

EDITS, TARGET = 0.2, 0.999
TABLES, SAMPLED = 8, 3
#: Walks by the words of a part that may have an edit; smaller parts have none, and one walk finds them all.
WALKS = dict.fromkeys(range(5, 11), 16)
#: Windows of so many bytes of text are embedded together.
SCAN_BYTES = 4 << 20
#: Words of windows that are held together.
WINDOW_WORDS = 2 << 20
_SCHEMA = "doc_id long, item_id long, distance int, item_words int, start int, length int"


def cgk(words: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """Embeds each row of a matrix of word hashes (0: past the end) in `steps` word hashes.

    The pointer of a row moves on if a random bit of (walk, step, word) is 1.
    """
    rows, width = words.shape
    padded = np.hstack([words, np.zeros((rows, 1), np.uint64)])
    at, out, line = np.zeros(rows, np.int64), np.empty((rows, steps), np.uint64), np.arange(rows)
    for step in range(steps):
        here = padded[line, at]
        out[:, step] = here
        at = np.minimum(at + (mix(here + np.uint64((walk * 100_003 + step) * 2 + 1)) >> np.uint64(63)).astype(np.int64), width)
    return out


def part_bounds(n_words: int, edits: float = EDITS) -> np.ndarray:
    """Bounds of an item's parts, of which one has at most one edit in every match."""
    parts = int(edits * n_words) // 2 + 1
    return np.arange(parts + 1) * n_words // parts


def walks_needed(edits: float = EDITS, target: float = TARGET) -> dict[int, int]:
    """Walks by the words of a part that may have an edit: the least power of 2 that `part_recall` finds to reach target."""
    if (edits, target) == (EDITS, TARGET):
        return WALKS
    sizes = {int(size) for n in range(1, int(8 / edits) + 1) if int(edits * n) for size in np.diff(part_bounds(n, edits))} if edits > 0 else set()
    out = {}
    for size in sorted(sizes):
        out[size] = 1
        while out[size] < 4096 and part_recall(size, out[size]) < target:
            out[size] *= 2
    return out


def _keys(words: np.ndarray, walks: int) -> Iterator[np.ndarray]:
    """The sampled hashes of each row of a matrix of word hashes, one array for each walk and table."""
    n_words = words.shape[1]
    for walk in range(walks):
        chosen = np.random.default_rng((n_words, walk)).integers(0, max(1, 2 * n_words - 2), (TABLES, SAMPLED))
        seen = cgk(words, walk, int(chosen.max()) + 1)
        for t in range(TABLES):
            key = np.full(len(words), walk * TABLES + t + 1, np.uint64)
            for step in chosen[t]:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + seen[:, step])
            yield key


def part_recall(n_words: int, walks: int, trials: int = 1000) -> float:
    """The share found of random parts with one edit, at the place and kind of edit where it is least."""
    rng = np.random.default_rng(n_words)
    part = rng.integers(1, 2**63, (trials, n_words), dtype=np.uint64)
    new = rng.integers(1, 2**63, (trials, 1), dtype=np.uint64)
    own, shares = list(_keys(part, walks)), []
    for i in range(n_words):
        for after in (part[:, i + 1 :], part[:, i:-1], np.hstack([part[:, i + 1 :], new])):
            edited = np.hstack([part[:, :i], after]) if after.shape[1] == n_words - i else np.hstack([part[:, :i], new, after])
            shares.append(np.any([a == b for a, b in zip(own, _keys(edited, walks), strict=True)], axis=0).mean())
    return min(shares)


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, length) of the stretch of text nearest to item by word edits: the first end, then the latest start of these."""
    n = len(item)
    cost, start = np.arange(n + 1), np.zeros(n + 1, np.int64)
    best = (n, 0, 0)
    ramp = np.arange(n + 1)
    for j, word in enumerate(text, 1):
        step = cost[:-1] + (item != word)
        up = cost[1:] + 1
        new = np.concatenate([[0], np.minimum(step, up)])
        came = np.concatenate([[j], np.where(step <= up, start[:-1], start[1:])])
        down = np.minimum.accumulate(new - ramp) + ramp
        at = np.maximum.accumulate(np.where(new == down, ramp, 0))
        cost, start = down, came[at]
        if cost[n] < best[0]:
            best = (int(cost[n]), int(start[n]), j - int(start[n]))
    return best


class _Items:
    """A broadcast list of items with a name that tells it from others in a Python worker."""

    def __init__(self, held, edits: float, walks: dict[int, int]):
        self.held, self.edits, self.walks, self.id = held, edits, walks, uuid.uuid4().hex


_BUILT: dict[str, Index] = {}


def _index(shared: _Items) -> Index:
    """The index of a broadcast list of items, built once in each Python worker."""
    if shared.id not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.id] = Index(shared.held.value, shared.edits, shared.walks)
    return _BUILT[shared.id]


class Index:
    """The benchmark's items, and the distinct parts of each size with their halves, sampled keys and owners."""

    def __init__(self, items: list[tuple[int | None, str | None]], edits: float = EDITS, walks: dict[int, int] = WALKS):
        self.edits, self.walks = edits, walks
        self.items, self.ids = [], []
        for item_id, text in dict.fromkeys(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), WORD)
            if len(starts):
                self.items.append(span_hashes(raw, starts, ends))
                self.ids.append(item_id)
        self.vocabulary = np.unique(np.concatenate([*self.items, np.zeros(0, np.uint64)]))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.codes = [np.unique(np.searchsorted(self.vocabulary, item), return_counts=True) for item in self.items]
        self.halves, self.tables, parts = {}, {}, {}
        for number, item in enumerate(self.items):
            bounds = part_bounds(len(item), edits).tolist()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                parts.setdefault(hi - lo, []).append((item[lo:hi], number, lo))
        for size, held in parts.items():
            words, number = np.unique(np.stack([h[0] for h in held]), axis=0, return_inverse=True)
            owner = np.argsort(number.ravel(), kind="stable")
            owners = np.array([h[1] for h in held])[owner], np.array([h[2] for h in held])[owner], np.cumsum([0, *np.bincount(number.ravel())])
            cut = self._cut(size)
            self.halves[size] = tuple(_Set(_runs(half.ravel(), np.arange(len(words)) * half.shape[1], half.shape[1])) for half in (words[:, :cut], words[:, cut:]))
            keys = [(key[order], order) for key in _keys(words, walks.get(size, 1)) for order in [np.argsort(key, kind="stable")]]
            self.tables[size] = words, keys, owners

    def _cut(self, size: int) -> int:
        """Words of a part's first half; a part without edits is all first half."""
        return size // 2 if size in self.walks else size

    def _windows(self, size: int, words: np.ndarray, known: np.ndarray, row_end: np.ndarray) -> np.ndarray:
        """Starts of the windows in which half of some part of this size stands: in its place, or one word off after an edit."""
        cut, total = self._cut(size), len(words)
        if not cut:
            return np.arange(total)
        first, second = self.halves[size]

        def found(half: _Set, length: int) -> np.ndarray:
            whole = np.flatnonzero(known[np.minimum(np.arange(total) + length, total)] - known[:-1] == length)
            whole = whole[whole + length <= row_end[whole]]
            return whole[half.holds(_runs(words, whole, length))]

        starts = found(first, cut)
        if cut < size:
            at = found(second, size - cut)
            row_start = np.concatenate([[0], np.flatnonzero(np.diff(row_end)) + 1])
            least = row_start[np.searchsorted(row_start, at, "right") - 1]
            starts = np.unique(np.concatenate([starts, *(np.maximum(at - cut + off, least) for off in (-1, 0, 1))]))
        return starts

    def _parts(self, size: int, words: np.ndarray, code: np.ndarray, starts: np.ndarray, row_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window's start, part) of all windows that agree with a part in a sample and have all but one of its words, by part."""
        parts, keys, _ = self.tables[size]
        total, met = len(words), [np.zeros(0, np.int64)]
        least, step = size - (size in self.walks), max(1, WINDOW_WORDS // size)
        for i in range(0, len(starts), step):
            start = starts[i : i + step]
            at = start[:, None] + np.arange(size)
            inside = at < row_end[start][:, None]
            at = np.minimum(at, total - 1)
            able = (inside & (code[at] < len(self.vocabulary))).sum(axis=1) >= least
            start, window = start[able], np.where(inside, words[at], np.uint64(0))[able]
            if not len(start):
                continue
            for key, (table, order) in zip(_keys(window, self.walks.get(size, 1)), keys, strict=True):
                left, right = np.searchsorted(table, key, "left"), np.searchsorted(table, key, "right")
                line = np.flatnonzero(right > left)
                for k in range(0, len(line), 2000):
                    some = line[k : k + 2000]
                    many = right[some] - left[some]
                    which = np.repeat(some, many)
                    mine = order[np.arange(len(which)) + np.repeat(left[some] - np.cumsum(many) + many, many)]
                    same = sum((parts[mine, j][:, None] == window[which]).any(axis=1).astype(np.int64) for j in range(size)) >= least
                    met.append(mine[same] * total + start[which[same]])
        pairs = np.unique(np.concatenate(met))
        return pairs % total, pairs // total

    def matches(self, words: np.ndarray, first_word: np.ndarray) -> Iterator[tuple[int, int | None, int, int, int, int]]:
        """(row, item, distance, item's words, start, length) in the texts whose words begin at first_word."""
        total = len(words)
        if not total or not len(self.vocabulary):
            return
        hit = np.flatnonzero(self.bits[(words >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, words[hit]), len(self.vocabulary) - 1)
        code = np.full(total, len(self.vocabulary), np.int32)
        code[hit] = np.where(self.vocabulary[at] == words[hit], at, len(self.vocabulary))
        known = np.concatenate([[0], np.cumsum(code < len(self.vocabulary))])
        sizes = np.diff(first_word)
        row_of, row_end = np.repeat(np.arange(len(sizes)), sizes), np.repeat(first_word[1:], sizes)
        by_item: dict[int, list[np.ndarray]] = {}
        for size, (_, _, (numbers, offsets, first)) in self.tables.items():
            windows, parts = self._parts(size, words, code, self._windows(size, words, known, row_end), row_end)
            bounds = np.flatnonzero(np.diff(parts, prepend=-1, append=-1)).tolist()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                for k in range(first[parts[lo]], first[parts[lo] + 1]):
                    by_item.setdefault(int(numbers[k]), []).append((windows[lo:hi], offsets[k]))
        mine, out = np.zeros(len(self.vocabulary) + 1, bool), []
        for item, held in by_item.items():
            n = len(self.items[item])
            spare, best = int(self.edits * n), {}
            row = np.concatenate([row_of[w] for w, _ in held])
            place = np.maximum(np.concatenate([w - offset for w, offset in held]), first_word[row])
            lo, hi = _merged(np.maximum(place - spare, first_word[row]), np.minimum(place + n + spare, first_word[row + 1]), row)
            codes, times = self.codes[item]
            mine[codes] = True
            lo, hi = _crowded(mine, code, lo, hi, n + spare, n - spare)
            mine[codes] = False
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                there = np.sort(code[a:b])
                have = np.searchsorted(there, codes, "right") - np.searchsorted(there, codes, "left")
                if np.minimum(have, times).sum() >= n - spare:
                    d, s, size = best_match(self.items[item], words[a:b])
                    r = int(row_of[a])
                    if d <= spare and (r not in best or d < best[r][0]):
                        best[r] = d, a + s - int(first_word[r]), size
            out.extend((r, item, *found) for r, found in best.items())
        for r, item, d, s, size in sorted(out):
            yield r, self.ids[item], d, len(self.items[item]), s, size


def _runs(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the `length` words from each start."""
    out = np.full(len(starts), length, np.uint64)
    for j in range(length):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[starts + j])
    return out


class _Set:
    """A set of hashes, most others told by one look into a bit table."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.bits = np.unique(hashes), np.zeros(1 << 22, bool)
        self.bits[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = self.bits[(hashes >> np.uint64(42)).astype(np.int64)]
        some = np.flatnonzero(out)
        out[some] = self.hashes[np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)] == hashes[some]
        return out


def _merged(lo: np.ndarray, hi: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of rows, those that meet in a row put together, in order."""
    order = np.lexsort((hi, lo, row))
    lo, hi, row = lo[order], hi[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])]))
    return lo[new], np.maximum.reduceat(hi, new)


def _crowded(mine: np.ndarray, code: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """What is left of stretches where `width` words have `least` of the marked ones."""
    sizes = hi - lo
    at = np.arange(sizes.sum()) + np.repeat(lo - np.cumsum(sizes) + sizes, sizes)
    end, which = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(sizes)), sizes)
    sums = np.concatenate([[0], np.cumsum(mine[code[at]])])
    some = np.flatnonzero(sums[np.minimum(np.arange(len(at)) + width, end)] - sums[:-1] >= least)
    if not len(some):
        return lo[:0], hi[:0]
    return _merged(at[some], np.minimum(at[some] + width, hi[which[some]]), which[some])


def contaminated(docs: DataFrame, benchmark: DataFrame, max_items: int = 20_000, max_bytes: int = 16 << 20, edits: float = EDITS, target: float = TARGET) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start, length): one row for each document and distinct (item_id, text) that it holds; places in words."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    blocks, walks = max(1, -(-size["n"] // max_items), -(-(size["bytes"] or 0) // max_bytes)), walks_needed(edits, target)
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = _Items(spark.sparkContext.broadcast([(r.item_id, r.text) for r in mine.collect()]), edits, walks)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), []
                for first, _, data, rows in text_slices(batch.column(1), SCAN_BYTES):
                    starts, ends, first_word = word_spans(data, rows, WORD)
                    out.extend((ids[first + m[0]], *m[1:]) for m in index.matches(span_hashes(data, starts, ends), first_word))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "distance", "item_words", "start", "length"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, _SCHEMA)
        out = part if out is None else out.union(part)
    return out
