"""Operators on small fixtures."""

from pyspark.sql import functions as F

from evidentia.operators import evidence, graph, journal, knowledge, retrieval


def test_graph_chain(spark):
    links = spark.createDataFrame([("S", "X"), ("M", "X"), ("M", "Y"), ("T", "Y")], "record string, entity string")
    seeds = spark.createDataFrame([(1, "S", 1.0), (2, "T", 1.0)], "query_id int, record string, weight double")
    assert {(r.query_id, r.record) for r in graph.diffusion(links, seeds, rounds=2).collect()} == {(1, "M"), (1, "T"), (2, "M"), (2, "S")}
    assert {(r.query_id, r.record) for r in graph.diffusion(links, seeds, rounds=1).collect()} == {(1, "M"), (2, "M")}


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "parent long, child long")
    roots = spark.createDataFrame([(1,)], "id long")
    assert {r.id for r in graph.closure(edges, roots).collect()} == {1, 2, 3}
    assert graph.closure(edges, roots.limit(0)).count() == 0


def test_rescaled_window(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 0.03, 5.0), (1, "b", 2, 0.02, 1.0), (1, "c", 3, 0.01, 9.0)], "query_id long, id string, rank int, score double, logit double")
    found = {r.id: r.score for r in retrieval.rescaled(ranked, "logit", 2).collect()}
    assert found == {"a": 2.0, "b": 1.0, "c": 0.01}


def test_overlap_matches_pairs(spark):
    rows = [(i, i % 3, "pqr"[i * 5 % 3], None if i % 11 == 0 else (i * 7) % 20, None if i % 13 == 0 else (i * 7) % 20 + i % 5) for i in range(60)]
    found = {r.k: r.overlaps for r in knowledge.overlapping(spark.createDataFrame(rows, "k int, o int, p string, s int, e int"), "o", "p", "s", "e", "k").collect()}
    real = [r for r in rows if r[3] is None or r[4] is None or r[4] > r[3]]
    for row in rows:
        k, o, p, s, e = row
        others = [r for r in real if r[1] == o and r[2] != p and (r[3] is None or e is None or r[3] < e) and (s is None or r[4] is None or s < r[4])]
        assert found[k] == (len(others) if row in real else 0)


def test_old_backfill_cannot_move_a_head(spark):
    operations = spark.createDataFrame([("i", 50, 1), ("i", 40, 2), ("j", 1, 3), ("j", 1, 4)], "item string, v int, seq int")
    assert {r.item: (r.v, r.seq) for r in knowledge.current_heads(operations, ["item"], "v", "seq").collect()} == {"i": (50, 1), "j": (1, 4)}
    assert {r.seq: r.late for r in knowledge.history_only(operations, ["item"], "v", "seq").collect()} == {1: False, 2: True, 3: False, 4: False}


def test_removed_items_stay_removed_for_backfills(spark):
    rows = [("a", 1, "upsert", "incremental", 5), ("a", 2, "remove", "incremental", None), ("a", 3, "upsert", "backfill", 9), ("b", 1, "remove", "incremental", None), ("b", 2, "restore", "incremental", None), ("c", 1, "upsert", "backfill", None), ("c", 2, "skip", "incremental", None)]
    found = {r.item: r.state for r in knowledge.item_states(spark.createDataFrame(rows, "item string, seq int, action string, role string, version int"), ["item"]).collect()}
    assert found == {"a": "removed", "b": "live", "c": "live"}


def test_predicates(spark):
    from evidentia.functions import rules, text as tx

    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    day = lambda d: F.lit(d).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    assert not one(rules.valid_at(day("2024-01-01"), none, none)) and one(rules.valid_at(none, none, none))
    assert one(rules.valid_at(day("2024-01-01"), none, day("2024-01-01"))) and not one(rules.valid_at(none, day("2024-01-01"), day("2024-01-01")))
    assert one(tx.literal_contains(F.lit("50%_Off É"), "%_off")) and not one(tx.literal_contains(F.lit("É"), "é")) and one(tx.literal_contains(F.lit("É"), "É"))
    assert one(tx.folded_terms(F.lit("The ﬁne STRAßE 12 ２３ x²"))) == ["fine", "strasse", "x2"]
    assert one(tx.clauses(F.lit(" a  b?\n; c;d;e;f"))) == ["a b", "c", "d", "e"]
    assert not one(rules.interval_sane(day("2024-01-02"), day("2024-01-01"))) and one(rules.interval_sane(day("2024-01-02"), none))
    assert [one(rules.backoff(F.lit(n))) for n in (0, 1, 7, 500)] == [30, 60, 3600, 3600]


def test_passages_are_found_whatever_their_words(spark):
    docs = spark.createDataFrame([(1, "xab cdy and more"), (2, "ab cd"), (3, "one two three four"), (4, None), (5, "xone two\nthreey")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ab cd"), (2, "b"), (3, "one two three"), (4, ""), (5, "one two\nthree"), (6, "two three")], "query_id long, passage string")
    found = {(r.query_id, r.doc_id) for r in retrieval.holding(docs, items).collect()}
    assert found == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (5, 5), (6, 3)}


def test_bm25_by_brute_force(spark):
    import math
    import random

    rng = random.Random(4)
    docs = [(d, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 30)))) for d in range(80)] + [(80, None)]
    asked = [(q, " ".join(rng.choices("abcdefghij", k=3))) for q in range(7)] + [(9, "?")]
    held = {d: t.split() for d, t in docs if t}
    mean = sum(map(len, held.values())) / len(held)
    scores = {}
    for q, text in asked:
        for d, words in held.items():
            if d % 3 == 0 or not set(words) & set(text.split()):
                continue
            scores[q, d] = sum(max(1e-6, math.log((len(held) - (n := sum(t in w for w in held.values())) + 0.5) / (n + 0.5))) * (tf := words.count(t)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean)) for t in set(text.split()) if t in words)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for block in (2048, 3):
        found = retrieval.bm25(frame, spark.createDataFrame(asked, "query_id long, text string"), 5, block=block, only=F.col("doc_id") % 3 != 0).collect()
        for q, _ in asked:
            want = sorted(((-round(s, 9), d) for (p, d), s in scores.items() if p == q))[:5]
            mine = sorted((r.rank, r.doc_id, r.score) for r in found if r.query_id == q)
            assert [d for _, d, _ in mine] == [d for _, d in want] and all(abs(s + w) < 1e-9 for (_, _, s), (w, _) in zip(mine, want, strict=True))


def test_lessons(spark):
    from evidentia.operators import learning

    candidates = spark.createDataFrame([(1, "f", 1, "a"), (2, "f", 2, "b"), (3, "f", 3, "a"), (4, "g", 1, "a")], "id int, family string, revision int, actor string")
    passed = spark.createDataFrame([(1, "x"), (2, "x"), (3, "a")], "id int, actor string")
    assert {r.id: r.state for r in learning.promoted(candidates, passed).collect()} == {1: "superseded", 2: "active", 3: "candidate", 4: "candidate"}


def test_feed_emits_the_first(spark):
    log = spark.createDataFrame([("c", 1, 90), ("c", 2, 5), ("d", 1, 3), ("d", 2, 3), ("d", 3, 9)], "c string, n int, size int")
    assert {(r.c, r.n) for r in journal.feed(log, "c", "n", "size", 10, 100).collect()} == {("c", 1), ("d", 1), ("d", 2)}


def test_diff_and_status(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, d string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d"), (3, None)], "k int, d string")
    assert {(r.k, r.status) for r in evidence.snapshot_diff(old, new, ["k"], "d").collect()} == {(1, "unchanged"), (2, "changed"), (3, "unchanged"), (4, "new")}
    assert {r.status for r in evidence.snapshot_diff(old, new.limit(0), ["k"], "d").collect()} == {"removed"}
    status = {r.k: r.status for r in evidence.ingest_status(new, old, spark.createDataFrame([(4,)], "k int"), ["k"], "d").collect()}
    assert status[1] == "duplicate" and status[2] == "conflict" and status[4] == "forgotten"


def test_neighbours_skip_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert [r.id for r in retrieval.neighbours(vectors, asked, 5).orderBy("rank").collect()] == [1, 2]
    assert retrieval.neighbours(vectors, asked.limit(0), 5).count() == 0


def test_branches_take_turns(spark):
    from evidentia.operators import recall

    hits = spark.createDataFrame([(1, "a", 1, 1, True), (1, "a", 2, 2, True), (1, "b", 1, 1, True), (1, "b", 3, 2, False), (1, "b", 4, 3, True)], "query_id int, branch string, id int, rank int, ok boolean")
    rows = recall.branches(hits, F.col("ok"), 10, 10).orderBy("place").collect()
    assert [(r.id, r.round, r.branch, r.branches) for r in rows] == [(1, 1, "a", ["a", "b"]), (2, 2, "a", ["a"]), (4, 2, "b", ["b"])]
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    free = lambda s, t: spark.range(1).select(recall.claimable(F.lit(s), F.to_timestamp(F.lit(t).cast("string")), now).alias("v")).first()["v"]
    assert free("pending", None) and free("leased", "2024-01-01 00:00:00") and not free("leased", "2024-01-03 00:00:00") and not free("complete", None)


def test_typed_hops_brute_force(spark):
    """Busy entities, repeated and looped relations and unknown ids, in any number of hops."""
    import random

    rng = random.Random(3)
    rows = [(rng.choice([None, *range(60), 7, 7]), rng.choice("pqrstuvw"), rng.choice([None, *"xyzpq"])) for _ in range(90)]
    edges = spark.createDataFrame(rows, "edge long, a string, b string").selectExpr("*", "timestamp(null) AS valid_from", "timestamp(null) AS valid_to")
    seeds = spark.createDataFrame([(s,) for s in "ppqrxz?"] + [(None,)], "id string")
    near = {(a, e, b) for e, a, b in rows if a} | {(b, e, a) for e, a, b in rows if b}
    for most, cap in ((1, 3), (2, 20), (3, 20), (3, 200)):
        want = set()
        for seed in "pqrxz":
            layer, hop_of = {seed}, {}
            for hop in range(1, most + 1):
                met = [(e, b) for a, e, b in near if a in layer]
                for e, _ in met:
                    hop_of.setdefault(e, hop)
                layer = {b for _, b in met if b}
            ranked = sorted(hop_of, key=lambda e: (hop_of[e], e is None, e or 0))
            want |= {(seed, e, hop_of[e], len(ranked) > cap) for e in ranked[:cap]}
        found = graph.typed_hops(edges, seeds, most, F.expr("TIMESTAMP '2024-01-10'"), cap).collect()
        assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_typed_hops_through_a_busy_entity(spark):
    """2,000 seeds that share an entity of 40,000 relations do not meet each of them: that would be 80 million pairs."""
    import time

    edges = spark.range(40_000).selectExpr("id AS edge", "concat('u', id) AS a", "'hub' AS b", "timestamp(null) AS valid_from", "timestamp(null) AS valid_to")
    seeds = spark.range(0, 40_000, 20).selectExpr("concat('u', id) AS id")
    began = time.monotonic()
    found = graph.typed_hops(edges, seeds, 2, F.expr("TIMESTAMP '2024-01-10'")).groupBy("seed").agg(F.count("*").alias("n"), F.sum("edge").alias("total"), F.min_by("edge", "hop").alias("own"), F.bool_and("truncated").alias("truncated")).collect()
    assert time.monotonic() - began < 30
    assert len(found) == 2000 and all(r.n == 200 and r.truncated and r.seed == f"u{r.own}" for r in found)
    assert all(r.total == (sum(range(200)) if r.own < 200 else sum(range(199)) + r.own) for r in found)
