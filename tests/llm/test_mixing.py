"""Mixing against its definition: targets by reshared excess, whole copies, sums near the targets."""

import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from evidentia.llm import mixing, queries
from evidentia.llm.mixing import mixed

KIND = "doc_id long, source string, text string, size int, taken string"


def targets(words, weights=(5, 2, 1), share=1.5, most=2):
    """The shares, told as in the definition: the excess over each bound goes to the others by weight, again and again."""
    names = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [None] * (None in words)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    due, fixed, left = {}, set(), share * sum(words.values())
    while True:
        free = [s for s in names if s not in fixed]
        due |= {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if due[s] > most * words[s]]
        if not above:
            return due
        for s in above:
            due[s] = most * words[s]
            fixed.add(s)
            left -= due[s]


def sizes(rows):
    words, longest = defaultdict(int), defaultdict(int)
    for _, source, text in rows:
        n = len(re.findall("[^\x20\x09-\x0d]+", text or ""))
        words[source] += n
        longest[source] = max(longest[source], n)
    return words, longest


def check(rows, found):
    words, longest = sizes(rows)
    due = targets(words) if sum(words.values()) else dict.fromkeys(words, 0)
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(i), len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, _, t in rows)
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == words[r.source] and math.isclose(r.target, due[r.source], rel_tol=1e-9, abs_tol=1e-9)
        share = due[r.source] / words[r.source] if words[r.source] else 0
        assert r.taken == r.copies * r.size and (not r.size or math.floor(share + 1e-9) <= r.copies <= math.ceil(share - 1e-9) <= 2)
        taken[r.source] += r.taken
    for s in words:
        assert abs(taken[s] - due[s]) <= longest[s] / 2 + 1e-6
    return taken, due


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    taken, due = check(rows, mixed(docs).collect())
    assert sum(abs(taken[s] - due[s]) for s in due) <= 0.03 * sum(due.values())
    first = {tuple(r) for r in queries.op11_mixing(spark, sf_dir).collect()}
    assert len(first) == docs.count()
    assert {tuple(r) for r in mixed(docs.repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()} == first


def test_levels_and_hot_classes(spark):
    """Several levels of blocks; a source of a few thousand documents meets its target almost to the word."""
    many = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"), F.array_join(F.array_repeat(F.lit("w"), (F.pmod(F.xxhash64("id"), F.lit(30)) + 1).cast("int")), " ").alias("text"))
    copies = spark.range(25_000).select(F.lit(7).cast("long").alias("id"), F.lit("same").alias("source"), F.lit("a b c").alias("text"))
    docs = many.union(copies).withColumnRenamed("id", "doc_id")
    rows = [tuple(r) for r in docs.collect()]
    taken, due = check(rows, mixed(docs).collect())
    assert abs(taken["big"] - due["big"]) <= 5 and abs(taken["same"] - due["same"]) <= 3


def test_copies_are_due_on_average(spark):
    """Of sources with many equal documents, each is taken as often as it is due, over many seeds."""
    docs = spark.createDataFrame([(i, "a" if i < 8 else "b", "w " * (3 + i % 8)) for i in range(200)], "doc_id long, source string, text string")
    times = defaultdict(int)
    for seed in range(6):
        for r in mixed(docs, weights=(1,), share=0.5, seed=seed).where("source = 'b'").collect():
            times[r.doc_id % 8] += r.copies
    assert all(0.3 < n / (6 * 24) < 0.7 for n in times.values())


def test_odd_rows(spark):
    rows = [(1, None, "a b c", 1, "x"), (1, None, "a b c", 1, "x"), (None, "s", None, 2, "y"), (None, "s", "", 2, "y"), (2, "s", "w " * 50_000, 3, "z"), (3, "é", " \t\n", 4, ""), (4, "z", "one", 5, ""), (4, "z", "one two", 5, "")]
    found = mixed(spark.createDataFrame(rows, KIND)).collect()
    check([r[:3] for r in rows], found)
    assert mixed(spark.createDataFrame([], KIND)).count() == 0
    empty = mixed(spark.createDataFrame([(1, "a", "", 0, ""), (2, None, None, 0, "")], KIND)).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2


def test_native(spark, sf_dir):
    plan = queries.op11_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_ranks_over_ranges(spark):
    names = [None] + [f"s{i}" for i in range(300)] + ["é", "\U0001f600", "￿"]
    held = mixing.ranked(spark.createDataFrame([(n,) for n in names], "source string"), "source").collect()
    order = [r.source for r in sorted(held, key=lambda r: r["rank"])]
    assert order == sorted(names[1:], key=lambda s: s.encode()) + [None]
    assert [r["rank"] for r in sorted(held, key=lambda r: r["rank"])] == list(range(len(names)))
