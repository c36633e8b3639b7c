"""Stored indexes against scans, and after upkeep against a rebuild."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.operators import cells, postings, retrieval

WORDS = [f"w{i}" for i in range(60)]


def texts(rng, ids):
    return [(i, " ".join(rng.choices(WORDS, weights=range(60, 0, -1), k=rng.randrange(0, 40)))) for i in ids]


def plain(found):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in found.collect())


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(q, " ".join(rng.sample(WORDS, 4))) for q in range(12)] + [(50, "nothing known"), (51, ""), (None, "w1")], "query_id long, text string")


def test_postings_find_what_a_scan_finds(spark, tmp_path, queries):
    rng = random.Random(1)
    rows = [*texts(rng, range(300)), (300, None), (301, "  "), (302, "W1 w1, É"), (None, "w1 w2")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, window int, ids string")
    index = postings.Postings(spark, str(tmp_path / "i"), shards=4, window=16).build(docs.repartition(5))
    assert plain(index.search(queries, 5)) == plain(retrieval.bm25(docs.where("doc_id is not null"), queries, 5))
    assert plain(index.search(queries, 5, block=3)) == plain(index.search(queries, 5))
    plan = index.search(queries, 5)._jdf.queryExecution().toString()
    assert "text" not in plan.split("Physical Plan")[1]


def test_postings_kept_up_equal_a_rebuild(spark, tmp_path, queries):
    rng = random.Random(2)
    held = dict(texts(rng, range(200)))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, forgotten boolean")
    index = postings.Postings(spark, str(tmp_path / "i"), shards=4, window=16).build(frame([(i, t, False) for i, t in held.items()]))
    for n in range(4):
        new = texts(rng, rng.sample(range(150 + 50 * n), 30) + [500 + n, 501 + n])
        gone = rng.sample(sorted(held), 15)
        index.change(frame([(i, t, False) for i, t in new] + [(i, None, True) for i in gone] + [(9000, None, True), (None, "w1", False)]))
        held = {i: t for i, t in (held | dict(new)).items() if i not in gone}
        now = frame([(i, t, False) for i, t in held.items()])
        want = plain(retrieval.bm25(now, queries, 7))
        assert plain(index.search(queries, 7)) == want
        if n == 2:
            index.merge()
            assert plain(index.search(queries, 7)) == want
    rebuilt = postings.Postings(spark, str(tmp_path / "j"), shards=4, window=16).build(now)
    assert plain(rebuilt.search(queries, 7)) == plain(index.search(queries, 7))
    assert index.parts.figure("docs") == rebuilt.parts.figure("docs") and index.parts.figure("length") == rebuilt.parts.figure("length")
    # A batch that broke off before its commit is not seen, and is written anew by the next.
    index.parts.write(spark.createDataFrame([(3, 5, 0)], postings._GONE), "gone", index.parts.next_batch())
    assert plain(index.search(queries, 7)) == want
    index.change(frame([(700, "w3 w4", False)]))
    assert plain(index.search(queries, 7)) == plain(retrieval.bm25(now.union(frame([(700, "w3 w4", False)])), queries, 7))


def test_empty_postings(spark, tmp_path, queries):
    none = spark.createDataFrame([], "doc_id long, text string, forgotten boolean")
    index = postings.Postings(spark, str(tmp_path / "i")).build(none)
    assert index.search(queries, 3).count() == 0
    assert postings.Postings(spark, str(tmp_path / "k")).search(queries, 3).count() == 0
    index.change(spark.createDataFrame([(1, "w1 w2", False), (1, "w1", False), (2, "w2", True), (2, "w2", False)], "doc_id long, text string, forgotten boolean"))
    assert {r.doc_id for r in index.search(queries, 3).collect()} <= {1}
    assert index.parts.figure("docs") == 1 and index.parts.figure("length") == 2



def test_windows_that_cannot_win_are_passed_over(spark):
    """Two terms: the first windows hold what wins, and after them lists are not decoded any more."""

    class Shared:
        value = ([7], np.array([0, 1, 2]), np.array([0, 0]), np.array([2.0, 1.0]))

    rows = [(0, w, i, list(range(10 * w, 10 * w + 10)), [9 if w == 0 else 1] * 10, [20] * 10, 9 if w == 0 else 1, 20) for w in range(200) for i in (0, 1)]
    kinds = pa.schema([("batch", pa.int32()), ("window", pa.int32()), ("i", pa.int32()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("dls", pa.list_(pa.int32())), ("most", pa.int32()), ("least", pa.int32())])
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
    looked = []
    real = np.unique
    try:
        np.unique = lambda x, **k: looked.append(len(x)) or real(x, **k)
        found = list(postings.scored(Shared, 2, 20.0)(iter([batch])))
    finally:
        np.unique = real
    assert found[0].column(1).to_pylist() == [0, 1]
    assert len(looked) <= 3


def test_cells(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 1500)] + 0.15 * rng.normal(size=(1500, 16))
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 3), (None, [1.0] * 16), (2004, [float("nan")] * 16)]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = retrieval.neighbours(vectors, asked, 10)
    index = cells.Cells(spark, str(tmp_path / "i")).build(vectors, cells=24, sample=700)
    same = lambda a: sorted((r.query_id, r["rank"], r.id, round(r.similarity, 8)) for r in a.collect())
    assert same(index.search(asked, 10)) == same(exact)
    probes = index.probes_for(0.97, 10)
    assert 1 <= probes <= 8
    few = index.search(asked, 10, probes=probes)
    hits = cells.recall(few, exact).agg(F.sum("hits"), F.sum("wanted")).first()
    assert hits[0] >= 0.95 * hits[1]
    one = index.search(asked.where("query_id = 0"), 10, probes=2)
    assert one.count() == 10
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    some = spark.range(0, 1500, 3)
    only = index.search(asked, 10, only=some)
    assert same(only) == same(retrieval.neighbours(vectors.where("vec_id % 3 = 0"), asked, 10))


def test_cells_kept_up(spark, tmp_path):
    rng = np.random.default_rng(4)
    held = {i: rng.normal(size=8).tolist() for i in range(300)}
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, forgotten boolean")
    index = cells.Cells(spark, str(tmp_path / "i")).build(frame([(i, x, False) for i, x in held.items()]))
    asked = spark.createDataFrame([(q, rng.normal(size=8).tolist()) for q in range(9000, 9010)], "query_id long, vector array<double>")
    for n in range(3):
        new = {int(i): rng.normal(size=8).tolist() for i in rng.choice(400, 40, replace=False)}
        gone = [int(i) for i in rng.choice(sorted(held), 20, replace=False)]
        index.change(frame([(i, x, False) for i, x in new.items()] + [(i, None, True) for i in gone]))
        held = {i: x for i, x in (held | new).items() if i not in gone}
        want = retrieval.neighbours(frame([(i, x, False) for i, x in held.items()]), asked, 6)
        same = lambda a: sorted((r.query_id, r["rank"], r.id, round(r.similarity, 8)) for r in a.collect())
        assert same(index.search(asked, 6)) == same(want)
    assert same(index.rebuild(cells=5).search(asked, 6)) == same(want)
    assert len(index.centroids()) == 5
    with pytest.raises(ValueError):
        cells.Cells(spark, str(tmp_path / "e")).build(frame([]))


def test_progressive_recall(spark):
    """Stages search only for queries that are not done; later finds lead, equal texts are told once, the budget cuts."""
    from evidentia.operators import recall

    lists = {
        "fast": {(1, 0): [10, 11], (2, 0): [20], (4, 0): [12]},
        "balanced": {(1, 0): [10, 11], (1, 1): [12, 13], (2, 0): [20], (4, 0): [12], (4, 1): [14]},
        "deep": {(1, 0): [10, 11], (1, 1): [12, 13], (1, 2): [15, 17], (4, 0): [12], (4, 1): [14]},
    }
    records = [(10, "x" * 40), (11, "same  text"), (12, "same text "), (13, "y" * 30), (14, ""), (15, None), (20, "z" * 200), (20_000, "never found")]
    queries = [(1, "one; two ? one"), (2, "alone"), (3, ""), (4, "a\nb"), (5, None)]
    counted = []

    def find(asked, depth):
        rows = [(r.query_id, r.variant) for r in asked.collect()]
        counted.append((depth, sorted(rows)))
        held = [(q, v, i, k) for q, v in rows for k, i in enumerate(lists[depth].get((q, v), []), 1)]
        return spark.createDataFrame(held, "query_id long, variant int, id long, rank int")

    told, last = recall.progressive(spark.createDataFrame(queries, "query_id long, text string"), find, spark.createDataFrame(records, "id long, text string"), limit=4, budget=75, shown=50)
    rows = sorted((r.query_id, r.place, r.id, r.chars, tuple(r.duplicates)) for r in told.collect())
    # Query 1: the last stage finds 10, 12, 15 and 11, the one before 13 as well; 15 has no text, 11 is 12 again, 13 is cut.
    assert rows == [(1, 1, 10, 40, ()), (1, 2, 12, 10, (11,)), (1, 3, 13, 25, ()), (2, 1, 20, 50, ()), (4, 1, 12, 10, ())]
    assert {r.query_id: (r.rounds, r.reason) for r in last.collect()} == {1: (3, "call_budget"), 2: (2, "no_new_candidates"), 3: (2, "no_new_candidates"), 4: (3, "no_new_candidates"), 5: (2, "no_new_candidates")}
    assert [(d, sorted({q for q, _ in a})) for d, a in counted] == [("fast", [1, 2, 3, 4, 5]), ("balanced", [1, 2, 3, 4, 5]), ("deep", [1, 4])]
    assert [a for _, a in counted][1] == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (4, 0), (4, 1), (4, 2), (5, 0)]
    told, last = recall.progressive(spark.createDataFrame(queries[:0], "query_id long, text string"), find, spark.createDataFrame(records, "id long, text string"))
    assert told.count() == 0 and last.count() == 0
