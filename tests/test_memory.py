"""Claims, lessons, consumers and records on small fixtures: nulls, ties, empty tables and repeated rows."""

import hashlib

from pyspark.sql import functions as F

from evidentia.operators import awareness, claims, evidence, knowledge, learning, recall, records, search


def test_claim_status_and_repair(spark):
    rows = spark.createDataFrame([(1, "s", 1, 10), (2, "s", 2, 10), (3, "t", 1, 20), (4, "u", 1, 30), (5, "v", 1, None)], "id int, scope string, n int, record_id int")
    stated = claims.statuses(rows, ["scope"], "n")
    assert {r.id: r.status for r in stated.collect()} == {1: "superseded", 2: "active", 3: "active", 4: "active", 5: "active"}
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "record_id int")
    found = {r.id: r.status for r in claims.repaired(stated, ids(20, 20, None), ids(10, 20)).collect()}
    assert found == {1: "superseded", 2: "retired", 3: "retracted", 4: "active", 5: "active"}
    assert claims.repaired(stated.limit(0), ids(20), ids(10)).count() == 0
    shown = lambda s, h: spark.range(1).select(claims.shown(F.lit(s), h).alias("v")).first()["v"]
    assert shown("active", False) and not shown("retired", False) and shown("retired", True) and not shown("retracted", True)


def test_attached_claims_are_the_newest(spark):
    held = spark.createDataFrame([(i, 7, i, "active") for i in range(40)] + [(100, 8, 1, "superseded")], "id int, record_id int, n int, status string")
    hits = spark.createDataFrame([(1, 7, 2), (1, 8, 1), (2, 9, 1)], "query_id int, record_id int, rank int")
    found = claims.attached(hits, held, [F.desc("n")], 35).orderBy("place").collect()
    assert [r.id for r in found] == list(range(39, 9, -1)) and {r.query_id for r in found} == {1}
    assert claims.attached(hits, held, [F.desc("n")], 35, history=True).orderBy("place").first().id == 100


def test_corrections_keep_to_their_scope(spark):
    beliefs = spark.createDataFrame([(1, "recorded", "a", None), (2, "recorded", "a", None), (3, "recorded", "b", None), (4, "retracted", "a", None)], "id int, state string, subject string, context string")
    given = spark.createDataFrame([(2, 1), (2, 2), (3, 1), (4, 2)], "id int, supersedes int")
    assert {r.id: r.state for r in claims.resolved(beliefs, given, ["subject", "context"]).collect()} == {1: "superseded", 2: "recorded", 3: "recorded", 4: "retracted"}


def test_bridges_follow_time(spark):
    day = lambda d: f"2024-01-{d:02}"
    links = spark.createDataFrame([(1, "acc", day(5)), (2, "acc", day(20)), (3, "other", day(6)), (4, "p", day(1))], "record int, entity string, at string").withColumn("at", F.to_timestamp("at"))
    known = spark.createDataFrame([("acc", "p", None, day(10)), ("other", "p", None, None)], "account string, person string, valid_from string, valid_to string")
    known = known.withColumn("valid_from", F.to_timestamp("valid_from")).withColumn("valid_to", F.to_timestamp("valid_to"))
    seeds = links.select(F.lit(1).alias("query_id"), "record", "at")
    assert {(r.from_record, r.id, r.via) for r in claims.bridged(seeds, links, known).collect()} == {(1, 3, "p"), (1, 4, "p"), (3, 1, "p"), (3, 4, "p")}


def test_lessons_fall_with_their_evidence(spark):
    objects = spark.createDataFrame([(1, "recorded"), (2, "active"), (3, "superseded"), (4, "candidate"), (5, "recorded")], "id int, state string")
    deps = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 5)], "parent int, child int")
    cited = spark.createDataFrame([(1, 100), (4, 200), (3, 300)], "id int, record_id int")
    gone = spark.createDataFrame([(100,), (300,), (None,)], "record_id int")
    assert {r.id: r.state for r in learning.invalidated(objects, deps, cited, gone).collect()} == {1: "invalidated", 2: "invalidated", 3: "invalidated", 4: "candidate", 5: "recorded"}
    assert {r.state for r in learning.invalidated(objects, deps, cited, gone.limit(0)).collect()} == {"recorded", "active", "superseded", "candidate"}


def test_evaluations_need_every_kind(spark):
    rows = [("a", k, True) for k in learning.KINDS] + [("b", "target", True)] * 3 + [("c", k, k != "target") for k in learning.KINDS]
    found = {r.id: (r.n_cases, r.passed, r.valid) for r in learning.evaluations(spark.createDataFrame(rows, "id string, kind string, candidate_pass boolean"), ["id"]).collect()}
    assert found == {"a": (3, True, True), "b": (3, True, False), "c": (3, False, True)}


def test_skip_rule(spark):
    rows = [("s", 1, 3000), ("s", 2, 2000), ("s", 3, 1000), ("s", 4, 1), ("t", 1, 9999)]
    frame = spark.createDataFrame(rows, "key string, n int, size int")
    assert {(r.key, r.n) for r in awareness.fitted(frame, "key", "n", "size", 8, 4000).collect()} == {("s", 1), ("s", 3)}
    assert {(r.key, r.n) for r in awareness.fitted(frame, "key", "n", "size", 1, 99_999).collect()} == {("s", 1), ("t", 1)}
    assert awareness.fitted(frame.limit(0), "key", "n", "size", 8, 4000).count() == 0


def test_retention_names_who_must_read_anew(spark):
    log = spark.createDataFrame([(i,) for i in range(10)], "seq int")
    consumers = spark.createDataFrame([("a", 9, 9), ("b", 2, 2), ("c", 9, 4)], "consumer string, cursor int, done_through int")
    open_ = spark.createDataFrame([("a", 7), ("d", 3)], "consumer string, seq_from int")
    left, late = awareness.compacted(log, consumers, open_, 5)
    assert {r.seq for r in left.collect()} == {6, 7, 8, 9} and {r.consumer for r in late.collect()} == {"b", "c", "d"}


def test_file_parts_and_copies(spark):
    files = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "k int, text string")
    found = sorted((r.k, r.part, r.start, r.piece) for r in records.parts(files, "k", "text", 3).collect())
    assert found == [(1, 0, 0, "abc"), (1, 1, 3, "def"), (1, 2, 6, "g"), (2, 0, 0, ""), (3, 0, 0, "")]
    old = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "k int, d string")
    new = spark.createDataFrame([(1, "y"), (3, None), (8, "x"), (9, "z")], "k int, d string")
    found = {r.k: (r.status, r.copy_of and r.copy_of.k) for r in records.copies(old, new, ["k"], "d").collect()}
    assert found == {1: ("changed", None), 2: ("removed", None), 3: ("unchanged", None), 8: ("new", 1), 9: ("new", None)}


def test_versions_end_once(spark):
    rows = [("m", 1, "add", "a"), ("m", 2, "add", "b"), ("m", 3, "replace", "a"), ("m", 4, "clear", None), ("m", 5, "add", "a"), ("m", 6, "remove", "a")]
    found = {r.version: r.retired_version for r in records.versions(spark.createDataFrame(rows, "target string, n int, action string, entry string"), "target", "entry", "n").collect()}
    assert found == {1: 3, 2: 4, 3: 4, 5: 6}


def test_ids_in_json(spark):
    texts = [None, "{", "[]", '{"a": [{"record_id": "r"}, {"record_ids": ["x", 3, "x"]}], "episodes": [{"id": "e"}, 4]}', '{"id": "w", "source": 1, "source_id": 2, "text": 3}', "[" * 20_000 + "]" * 20_000]
    found = [r.record_ids for r in records.evidence_ids(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string"), "j").orderBy("i").collect()]
    assert found[:5] == [[], [], [], ["e", "r", "x"], ["w"]] and found[5] == []


def test_numbers_and_levels(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(53)], "a int, b int")
    found = sorted((r.a, r.b, r.place) for r in evidence.numbered(rows, ["a", "b"]).collect())
    assert [p for *_, p in found] == list(range(53))
    sizes = {r.level: r["count"] for r in evidence.levels(evidence.numbered(rows, ["a", "b"]), "place", 5).groupBy("level").count().collect()}
    assert sizes == {0: 53, 1: 11, 2: 3, 3: 1}


def test_snapshots_stream(spark):
    rows = spark.createDataFrame([(k, i, f"d{i}") for k in (1, 2) for i in range(k * 300)] + [(None, 1, "d")], "k int, n int, d string")
    found = {r.k: (r.n_records, r.fingerprint) for r in evidence.snapshots(rows, "k", "n", "d").collect()}
    assert found == {k: (k * 300, hashlib.sha256("".join(f"d{i}" for i in range(k * 300)).encode()).hexdigest()) for k in (1, 2)}


def test_lists_of_duplicates_are_bounded(spark):
    rows = spark.createDataFrame([(i, "same") for i in range(500)] + [(900, "other")], "k int, t string")
    found = evidence.duplicate_lists(rows, "k", F.col("t"), 50).collect()
    assert sorted(k for r in found for k in r.duplicates) == list(range(1, 500)) and max(len(r.duplicates) for r in found) < 120


def test_event_states(spark):
    log = [("a", 1, "claim"), ("a", 2, "ack"), ("b", 1, "claim"), ("b", 2, "retry"), ("c", 1, "ack"), ("d", 1, "claim"), ("d", 2, "claim"), ("d", 3, "claim"), ("e", 1, "claim")]
    found = {r.k: r.state for r in knowledge.event_states(spark.createDataFrame(log, "k string, n int, command string"), "k", "n").collect()}
    assert found == {"a": "delivered", "b": "pending", "c": "pending", "d": "quarantined", "e": "leased"}


def test_identical_branches_share_a_search(spark):
    told = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "x"), (2, 0, "x")], "query_id int, branch int, text string")
    searches, answers = recall.shared_searches(told)
    assert {(r.query_id, r.search, r.text) for r in searches.collect()} == {(1, 0, "x"), (1, 1, "y"), (2, 0, "x")}
    assert {(r.query_id, r.branch, r.search) for r in answers.collect()} == {(1, 0, 0), (1, 1, 1), (1, 2, 0), (2, 0, 0)}


def test_hybrid_search_rejects_and_hides(spark):
    texts = {1: "my office is river road", 2: "my office is here, the number is 2023", 3: "blood type is A", 4: "river road office hidden"}
    docs = spark.createDataFrame([(i, t, None) for i, t in texts.items()], "id long, text string, at timestamp")
    asked = spark.createDataFrame([(1, 0, "Where was my office in 2023?"), (1, 1, "river road"), (2, 0, "What is my blood type?"), (3, 0, "number 2023")], "query_id long, variant int, text string")
    hidden = spark.createDataFrame([(4,)], "id long")
    now = F.to_timestamp(F.lit("2024-01-01"))
    found = {(r.query_id, r.id) for r in search.hybrid(docs, asked, now, hidden=hidden).collect()}
    assert found == {(1, 1), (1, 2), (2, 3)}
    excluded = spark.createDataFrame([(1, 1)], "query_id long, id long")
    assert {(r.query_id, r.id) for r in search.hybrid(docs, asked, now, hidden=hidden, excluded=excluded).collect()} == {(1, 2), (2, 3)}
    links = spark.createDataFrame([(3, "e"), (1, "e")], "record long, entity string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in texts], "id long, vector array<float>")
    near = search.hybrid(docs, asked, now, vectors, vectors.where("id = 3").select(F.lit(2).cast("long").alias("query_id"), "vector"), links=links, depth="balanced")
    assert {r.id for r in near.where("query_id = 2").collect()} == {1, 2, 3, 4}
    assert search.hybrid(docs.limit(0), asked, now).count() == 0 and search.hybrid(docs, asked.limit(0), now).count() == 0
