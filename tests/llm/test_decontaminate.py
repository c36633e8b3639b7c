"""Contaminated documents against the exact distance to every item."""

import random
import re

import numpy as np

from evidentia.llm import queries
from evidentia.llm.decontaminate import EDITS, TARGET, WALKS, Index, best_match, contaminated, part_bounds, part_recall, walks_needed

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def nearest(item, text):
    """Least word edits from item to any stretch of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for word in text:
        new = [0]
        for i, own in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (own != word)))
        row = new
        best = min(best, row[-1])
    return best


def lowered(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for d, text in docs:
        for i, passage in items:
            own = lowered(passage)
            if own and d is not None and i is not None and (n := nearest(own, lowered(text))) <= int(EDITS * len(own)):
                out[d, i] = n
    return out


def test_brute_force(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("a", "é", "ou")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([6, 15, 30])))) for i in range(12)] + [(50, None), (51, "..."), (None, "a b")]
    docs = []
    for d in range(60):
        own = items[d % 12][1].split()
        for _ in range(d % 8):
            at = rng.randrange(len(own))
            own[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"], [rng.choice(words)]])
            own = own or ["x"]
        docs.append((d, " ".join(rng.choices(words, k=d)) + ". " + " ".join(own).upper() + "\n" + " ".join(rng.choices(words, k=9))))
    docs += [(100, None), (101, ""), (102, "--"), (103, " ".join(items[2][1].split()[1:])), (104, "ba " * 5000)]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    found = {(r.doc_id, r.item_id): r.distance for r in contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == brute(docs, items)
    blocks = {(r.doc_id, r.item_id): r.distance for r in contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), max_items=5).collect()}
    assert blocks == found


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contaminated(docs.limit(0), items).count() == 0
    assert contaminated(docs, items.limit(0)).count() == 0


def test_repeated_and_null_item_ids(spark):
    items = [(1, "a b c d"), (1, "e f g h"), (1, "i j k"), (1, "i j k"), (None, "l m n o"), (None, "p q r")]
    docs = [(d, f"x {text} y") for d, (_, text) in enumerate(items)]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id or 0, r.item_words) for r in found) == [(0, 1, 4), (1, 1, 4), (2, 1, 3), (3, 1, 3), (4, 0, 4), (5, 0, 3)]


def test_recall_of_long_items():
    """Every length and kind of edit up to the allowed share: all that brute force finds."""
    rng = random.Random(9)
    for n in (15, 31, 50, 80, 120, 200, 300):
        items = rng.sample(range(1, 1 << 40), 4 * n)
        index = Index([(i, " ".join(f"w{w}" for w in items[i * n : i * n + n])) for i in range(4)])
        texts = []
        for trial in range(24):
            own = index.items[trial % 4].tolist()
            for _ in range(int((EDITS if trial % 8 < 5 else EDITS / 2) * n)):
                at = rng.randrange(len(own))
                own[at : at + (trial % 3 != 1)] = [] if trial % 3 == 2 else [rng.getrandbits(60)]
            texts.append([rng.getrandbits(60) for _ in range(9)] + own + [rng.getrandbits(60) for _ in range(9)])
        found = {(m[0], m[1]): m[2] for m in index.matches(np.array(sum(texts, []), np.uint64), np.cumsum([0, *map(len, texts)]))}
        want = {(t, i): d for t, text in enumerate(texts) for i in range(4) if (d := best_match(index.items[i], np.array(text, np.uint64))[0]) <= int(EDITS * n)}
        assert found == want and len(want) == 24


def test_very_long_items():
    rng = random.Random(10)
    items = [" ".join(f"w{rng.getrandbits(40)}" for _ in range(n)) for n in (640, 20_000)]
    index = Index(list(enumerate(items)))
    texts = []
    for item in index.items:
        own = item.tolist()
        for _ in range(int(EDITS * len(own))):
            own[rng.randrange(len(own))] = rng.getrandbits(60)
        texts.append([1, 2, 3] + own + [4, 5])
    found = {(m[0], m[1]) for m in index.matches(np.array(sum(texts, []), np.uint64), np.cumsum([0, *map(len, texts)]))}
    assert found == {(0, 0), (1, 1)}


def test_other_parameters(spark):
    walks = walks_needed(0.1, 0.9)
    assert min(walks) == 10 and all(part_recall(size, n) >= 0.9 for size, n in walks.items()) and walks_needed() is WALKS
    rng = random.Random(11)
    items = [(i, " ".join(f"w{rng.getrandbits(30)}" for _ in range(40))) for i in range(5)]
    edited = lambda text, n: " ".join(w for i, w in enumerate(text.split()) if i % 7 or i >= 7 * n)
    docs = [(10 * i + n, "a b " + edited(text, n) + " c") for i, text in items for n in (0, 4, 5)]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), edits=0.1, target=0.99, max_bytes=600)
    assert {(r.doc_id, r.item_id, r.distance) for r in found.collect()} == {(10 * i + n, i, n) for i in range(5) for n in (0, 4)}


def test_target_recall_of_parts():
    for n in range(1, 400):
        sizes = np.diff(part_bounds(n))
        assert sizes.sum() == n and (int(EDITS * n) == 0 or all(size in WALKS for size in sizes))
    assert all(part_recall(size, walks) >= TARGET for size, walks in WALKS.items())


def zipf(rng, n, words=400):
    return [rng.choices(range(1, words), [1 / w for w in range(1, words)])[0] * (1 << 40) + 1 for _ in range(n)]


def test_common_words_and_many_items():
    """Thousands of items of the same few common words: all that brute force finds, whatever halves and parts they share."""
    rng = random.Random(12)
    items = [zipf(rng, rng.randint(5, 40)) for _ in range(1500)]
    index = Index([(i, " ".join(f"w{w}" for w in item)) for i, item in enumerate(items)])
    code = {f"w{w}": h for item, hashes in zip(items, index.items, strict=True) for w, h in zip(item, hashes.tolist(), strict=True)}
    texts = []
    for t in range(12):
        own = [f"w{w}" for w in items[100 * t]]
        for _ in range(int(EDITS * len(own))):
            own[rng.randrange(len(own))] = f"w{zipf(rng, 1)[0]}"
        texts.append([code.get(w, 7) for w in [f"w{v}" for v in zipf(rng, 30)] + own + [f"w{v}" for v in zipf(rng, 30)]])
    found = {(m[0], m[1]): m[2] for m in index.matches(np.array(sum(texts, []), np.uint64), np.cumsum([0, *map(len, texts)]))}
    some = range(0, 1500, 10)
    want = {(t, i): d for t, text in enumerate(texts) for i in some if (d := best_match(index.items[i], np.array(text, np.uint64))[0]) <= int(EDITS * len(index.items[i]))}
    assert {k: d for k, d in found.items() if k[1] % 10 == 0} == want and {(t, 100 * t) for t in range(12)} <= set(want)


def test_a_template_of_all_items():
    """Parts that 2,000 items share are kept once, and only items whose own words stand there are aligned."""
    rng = random.Random(13)
    shared = " ".join(f"t{rng.getrandbits(30)}" for _ in range(40))
    items = [(i, shared + " " + " ".join(f"w{rng.getrandbits(40)}" for _ in range(40))) for i in range(2000)]
    index = Index(items)
    assert sum(len(words) for words, _, _ in index.tables.values()) < 2000 * 5 + 10
    texts = [index.items[3][:40].tolist() + [1, 2, 3], index.items[5].tolist(), index.items[9][:40].tolist() * 200]
    found = list(index.matches(np.array(sum(texts, []), np.uint64), np.cumsum([0, *map(len, texts)])))
    assert found == [(1, 5, 0, 80, 0, 80)]


def test_place_of_a_match():
    item, text = np.array([1, 2, 3, 4], np.uint64), np.array([9, 9, 1, 2, 7, 3, 4, 9, 1, 2, 3, 4], np.uint64)
    assert best_match(item, text) == (0, 8, 4)


def test_whole_passages_are_found(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(d, i) for d, text in docs.items() for i, passage in items.items() if passage in (text or "")}
    assert want <= {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, sf_dir).collect()}
