"""Periodic runs against every period of every stretch."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from evidentia.llm import queries
from evidentia.llm.periodic_runs import common_prefixes, periodic_runs, runs_of, suffix_order

KIND = "doc_id long, text string, runs int, n_words string"


def brute(words, least=24, times=3):
    """Every maximal stretch of each period that no smaller period has too."""
    n, out, known = len(words), [], set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and not any(s <= i and i + length <= s + m for s, m in known):
                out.append((i, length, q))
                known.add((i, length))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_random_sequences(letters):
    rng = random.Random(letters)
    for least, times in ((2, 2), (4, 3), (24, 3), (7, 4)):
        for _ in range(120):
            x = []
            while len(x) < 60:
                part = [rng.randrange(letters) for _ in range(rng.randrange(1, 8))]
                x += part * rng.randrange(1, 9)
            assert sorted(runs_of(np.array(x), least, times), key=lambda r: (r[0], r[2])) == brute(x, least, times)


def test_suffixes_and_prefixes():
    rng = random.Random(0)
    for size in (1, 2, 50, 400):
        x = [rng.randrange(2) for _ in range(size)]
        order = suffix_order(np.array(x))
        assert order.tolist() == sorted(range(size), key=lambda i: x[i:])
        for k, found in enumerate(common_prefixes(np.array(x), order).tolist()):
            a, b = (x[order[k - 1] :], x[order[k] :]) if k else ([], [])
            assert found == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def test_long_texts():
    """Linear times a logarithm: a period all through, one word only, and Fibonacci words."""
    began = time.perf_counter()
    x = np.tile(np.arange(20), 10_000)
    assert runs_of(x, 24, 3) == [(0, 200_000, 20)]
    assert runs_of(np.zeros(200_000, np.int64), 24, 3) == [(0, 200_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    assert len(runs_of(np.array(b), 24, 3)) > 1000
    assert time.perf_counter() - began < 60


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def told(doc_id, text):
    words = looped(doc_id, split(text))
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(kept)))


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(split(r.text)) < 2500]
    found = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    for doc_id, text in rows:
        assert found[doc_id] == told(doc_id, text), doc_id
    assert sum(r[0] for r in found.values()) > 10


def test_odd_rows(spark):
    loop = "a b c " * 30
    rows = [(1, None, 0, ""), (2, "", 0, ""), (3, " \t\n", 0, ""), (None, loop, 0, ""), (4, loop + "x", 0, ""), (4, loop + "x", 0, ""), (5, " é " * 40 + "É é", 0, ""), (6, " one\x0btwo ", 0, ""), (7, "A a " * 20, 0, "")]
    found = periodic_runs(spark.createDataFrame(rows, KIND)).collect()
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found)
    assert got == sorted(
        [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (0, 90, [(0, 90, 3)], "a b c"), (4, 91, [(0, 90, 3)], "a b c x"), (4, 91, [(0, 90, 3)], "a b c x")]
        + [(5, 42, [(0, 40, 1)], " é É é"), (6, 2, [], "one two"), (7, 40, [(0, 40, 2)], "A a")]
    )
    assert periodic_runs(spark.createDataFrame([], KIND)).count() == 0
