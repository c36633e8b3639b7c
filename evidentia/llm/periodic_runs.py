"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of words with smallest period q, at least min_length words and min_repeats * q long, that no
neighbouring word extends. Suffixes of a text are sorted, and the classes of suffixes united by decreasing common prefix,
with union-find over ordered sets of positions. When two sets are united at a common prefix of l words, positions i < j
that become neighbours with (min_repeats - 1) * (j - i) <= l seed a run of period j - i: it starts at i, has l + j - i
words and cannot be extended to the right; it is one if the words before i and j differ. A smaller period would have put a
position between. Each run is seeded once, by its first word and the one a period on.

A run has a common prefix of at least min_length * (min_repeats - 1) / min_repeats words with itself one period on, so the
uniting ends at that length, and texts without a repeated stretch of so many words have no run: hashes tell that without
sorting suffixes. Texts with one are numbered by their words (not hashes), and the suffixes of several texts are sorted
together, by doubling; words of different texts have different numbers. Common prefixes come from the irreducible ones,
whose sum is at most n log n.

A null text or one without words has no run. Texts of any length count whole; memory follows the longest. Repeated rows
and null ids give a row each. An empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NON_SPACE, mix, span_hashes, text_slices, word_spans

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words that common prefixes are first compared for, all at once.
_AT_ONCE = 64


def repeats(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Which texts have a stretch of `width` words twice, by hash: none that has is left out. first: each text's first word."""
    n, texts = len(words), len(first) - 1
    if n < width:
        return np.zeros(texts, bool)
    text = np.repeat(np.arange(texts), np.diff(first))
    held, size = mix(words + text.astype(np.uint64) * _BASE), 1
    while 2 * size <= width:
        held, size = mix(held[:-size] * _BASE + held[size:]), 2 * size
    rest = width - size
    held = mix(held[: len(held) - rest] * _BASE + held[rest:])
    at = np.flatnonzero(np.arange(len(held)) + width <= first[1:][text[: len(held)]])
    order = at[np.argsort(held[at])]
    same = held[order[1:]] == held[order[:-1]]
    out = np.zeros(texts, bool)
    out[text[order[1:][same]]] = True
    return out


def suffix_order(x: np.ndarray) -> np.ndarray:
    """The suffixes of x in order, by doubling; only what is not yet apart is sorted again."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    slot, rank = np.arange(n), np.empty(n, np.int64)
    begins = np.ones(n, bool)
    begins[1:] = x[order[1:]] != x[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(begins, slot, 0))
    reach = 1
    while True:
        alone = begins.copy()
        alone[:-1] &= begins[1:]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order
        at = order[open_]
        then = at + reach
        key = rank[at] * (n + 1) + np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[open_] = at
        apart = np.ones(len(key), bool)
        apart[1:] = key[1:] != key[:-1]
        begins[open_] = apart
        rank[at] = np.maximum.accumulate(np.where(apart, open_, 0))
        reach *= 2


def common_prefixes(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each suffix with the one before it in order (0 for the first), by place in order."""
    n = len(x)
    held = np.append(x, -1)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    reducible = (i > 0) & (before > 0) & (x[i - 1] == x[np.maximum(before, 1) - 1])
    own = np.flatnonzero(~reducible & (before >= 0))
    size, live = np.zeros(len(own), np.int64), np.arange(len(own))
    for off in range(_AT_ONCE):
        a, b = own[live] + off, before[own[live]] + off
        live = live[(np.maximum(a, b) < n) & (held[np.minimum(a, n)] == held[np.minimum(b, n)])]
        size[live] += 1
        if not len(live):
            break
    for t in live.tolist():
        a, b, block = int(own[t]) + _AT_ONCE, int(before[own[t]]) + _AT_ONCE, _AT_ONCE
        while (m := min(block, n - max(a, b))) > 0:
            differ = np.flatnonzero(x[a : a + m] != x[b : b + m])
            if len(differ):
                size[t] += int(differ[0])
                break
            size[t] += m
            a, b, block = a + m, b + m, 4 * block
    at = np.full(n, -1, np.int64)
    at[own] = np.arange(len(own))
    root = np.maximum.accumulate(np.where(~reducible, i, 0))
    prefix = np.where(at[root] >= 0, size[at[root]] if len(size) else 0, 0) - (i - root)
    return np.maximum(prefix, 0)[order]


def runs_of(x: np.ndarray, min_length: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, in no order."""
    if len(x) < min_length:
        return []
    order = suffix_order(x)
    prefix = common_prefixes(x, order)
    least = -(-min_length * (min_repeats - 1) // min_repeats)
    edges = np.flatnonzero(prefix >= max(least, 1))
    edges = edges[np.argsort(-prefix[edges], kind="stable")]
    home: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    seeds: list[tuple[int, int, int]] = []

    def root(i: int) -> int:
        found = home.setdefault(i, i)
        while found != home[found]:
            home[found] = found = home[home[found]]
        return found

    for i, j, reach in zip(order[edges - 1].tolist(), order[edges].tolist(), prefix[edges].tolist(), strict=True):
        a, b = root(i), root(j)
        large, small = held.pop(a, None) or [a], held.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        home[b] = a
        for p in small:
            insort(large, p)
        held[a] = large
        own, far = set(small), reach // (min_repeats - 1)
        for p in small:
            at = bisect_left(large, p)
            # Those of one set were neighbours before, or are none now.
            if at and p - large[at - 1] <= far and large[at - 1] not in own:
                seeds.append((large[at - 1], p, reach))
            if at + 1 < len(large) and large[at + 1] - p <= far and large[at + 1] not in own:
                seeds.append((p, large[at + 1], reach))
    out = {(i, reach + j - i, j - i) for i, j, reach in seeds if reach + j - i >= min_length and (i == 0 or x[i - 1] != x[j - 1])}
    return list(out)


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts as numbers, equal for equal words of one text and for no others, and each text's first place."""
    parts, first, used = [], [0], 0
    for text in texts:
        ids: dict[bytes, int] = {}
        parts.append(np.array([ids.setdefault(w, len(ids)) for w in text.split()], np.int64) + used)
        used += len(ids)
        first.append(first[-1] + len(parts[-1]))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(first)


def _collapsed(data: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each text joined by one space, and the texts' offsets in them."""
    out = data.copy()
    change = np.zeros(len(data) + 1, np.int8)
    change[starts[kept]] += 1
    change[ends[kept]] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    text = np.repeat(np.arange(len(rows) - 1), np.diff(first))[kept]
    later = np.zeros(len(text), bool)
    later[1:] = text[1:] == text[:-1]
    gaps = starts[kept][later] - 1
    out[gaps], inside[gaps] = 0x20, True
    size = np.concatenate([[0], np.cumsum(inside)])
    return out[inside], size[rows]


_OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, min_length: int = 24, min_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs.

    runs: (start, length, period), in words from 0, by start, then period; collapsed: the words that no run contains after
    its first period, joined by one space. Words are what stands between white space.
    """
    if min_repeats < 2 or min_length < 2:
        raise ValueError("a run has two words and two periods at least")
    width = max(1, -(-min_length * (min_repeats - 1) // min_repeats))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, rows in text_slices(batch.column(1)):
                starts, ends, first = word_spans(data, rows, NON_SPACE)
                again = np.flatnonzero(repeats(span_hashes(data, starts, ends), first, width)).tolist()
                x, at = _numbered([data[rows[t] : rows[t + 1]].tobytes() for t in again])
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(high - low)]
                dropped = np.zeros(len(starts) + 1, np.int64)
                for s, length, q in sorted(runs_of(x, min_length, min_repeats), key=lambda r: (r[0], r[2])):
                    k = int(np.searchsorted(at, s, "right")) - 1
                    begin = s - int(at[k])
                    found[again[k]].append((begin, length, q))
                    dropped[first[again[k]] + begin + q] += 1
                    dropped[first[again[k]] + begin + length] -= 1
                raw, offsets = _collapsed(data, rows, starts, ends, first, np.cumsum(dropped[:-1]) == 0)
                texts = pa.LargeStringArray.from_buffers(high - low, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())
                flat = [r for part in found for r in part]
                columns = [pa.array([r[c] for r in flat], pa.int64()) for c in range(3)]
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(run_type)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(first)), listed, texts], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(find, f"doc_id long, {_OUT}")
