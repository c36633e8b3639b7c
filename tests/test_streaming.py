"""Streams over files, run to their end."""

from pyspark.sql import functions as F

from evidentia.streaming import ingest

SCHEMA = "source string, source_id string, revision string, text string"


def test_ingest_is_idempotent(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    spark.createDataFrame([("s", "1", "1", "a"), ("s", "1", "1", "a"), ("s", "2", "1", "b")], SCHEMA).coalesce(1).write.json(str(folder / "x"))
    stream = lambda: spark.readStream.schema(SCHEMA).json(str(folder / "*"))
    ingest.ingest(stream(), store, str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(store).where("status = 'new'").count() == 2
    batch = spark.createDataFrame([("s", "1", "1", "a"), ("s", "2", "1", "changed"), ("s", "3", "1", "c")], SCHEMA)
    for _ in range(2):
        ingest.accept(batch, 7, store)
    found = {(r.source_id, r.status) for r in spark.read.parquet(store).where("batch_id = 7").collect()}
    assert found == {("1", "duplicate"), ("2", "conflict"), ("3", "new")}
    assert spark.read.parquet(store).where("batch_id = 7").count() == 3


def _files(spark, rows, schema, folder, pieces):
    """rows in `pieces` files, in the order of their names and times."""
    import os

    for i in range(pieces):
        part = rows[i * len(rows) // pieces : (i + 1) * len(rows) // pieces]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"{i:03}"))
        for f in os.listdir(folder / f"{i:03}"):
            os.utime(folder / f"{i:03}" / f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


LOG = "item string, n long, d string, m string, role string, arrival string"


def test_journal_in_any_batching(spark, tmp_path):
    import random

    from evidentia.operators import journal
    from evidentia.streaming import stateful

    rng = random.Random(4)
    rows = [(rng.choice("abcdefghijklmnopqrst"), n, rng.choice(["x", "x", "y", None]), rng.choice("pppq"), rng.choice(["backfill"] * 4 + ["incremental"] * 2 + [None]), rng.choice(["fresh", "fresh", None])) for n in range(200)]
    log = spark.createDataFrame(rows, LOG)
    want = {(r.item, r.n, r.kind, r.transition_version, r.refinement) for r in journal.transitions(log, "item", "n", "d", "m", "role", "arrival").collect()}
    assert {r[2] for r in want} == {"created", "content_updated", "metadata_updated", "unchanged"} and any(r[4] for r in want)
    for pieces in (1, 5):
        stream = _files(spark, rows, LOG, tmp_path / f"in{pieces}", pieces)
        found = stateful.drained(stateful.journalled(stream, "item", "n", "d", "m", "role", "arrival"), str(tmp_path / f"out{pieces}"))
        assert {tuple(r) for r in found.collect()} == want
    # A second run over the same folder reads nothing twice and goes on from the state.
    more = [("a", 1000, "new", "p", "incremental", "fresh")]
    spark.createDataFrame(more, LOG).coalesce(1).write.parquet(str(tmp_path / "in5" / "999"))
    again = stateful.drained(stateful.journalled(spark.readStream.schema(LOG).parquet(str(tmp_path / "in5" / "*")), "item", "n", "d", "m", "role", "arrival"), str(tmp_path / "out5"))
    version = max(r[3] for r in want if r[0] == "a")
    assert {tuple(r) for r in again.collect()} == want | {("a", 1000, "content_updated", version + 1, False)}


EVENTS = "c string, d string, g string, n long, size long, ts timestamp"


def test_sweeps_in_any_batching(spark, tmp_path):
    import random
    from collections import defaultdict
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from evidentia.streaming import stateful

    from test_queries import sweep

    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), rng.choice("uv"), rng.choice("xyz"), n, rng.choice([100, 900, 5000]), start + timedelta(minutes=20 * n)) for n in range(150)]
    held = defaultdict(list)
    for c, d, g, n, size, ts in rows:
        held[c, (ts - start) // timedelta(hours=8)].append((d, g, n, size))
    want = {(c, n, batch) for (c, window), own in held.items() if window < 6 for n, batch in sweep(own, 3, 4000).items()}
    assert rows[-1][5] - start >= timedelta(hours=48)
    for pieces in (1, 6):
        stream = _files(spark, rows, EVENTS, tmp_path / f"in{pieces}", pieces)
        swept = stateful.sweeps(stream, "c", F.col("d"), "g", "n", "size", "ts", 28_800, 3, 4000)
        found = stateful.drained(swept, str(tmp_path / f"out{pieces}")).collect()
        whole = {(r.consumer, r.seq, r.batch) for r in found}
        assert {r for r in whole if (rows[r[1]][5] - start) < timedelta(hours=48)} == want
        assert all(r.cursor >= r.seq for r in found)


def test_swept_stream_of_files_that_overlap(spark, tmp_path):
    """Files in no order of time, events within half a second of a window's end, one at its very end, and what is null."""
    import random
    from datetime import datetime, timedelta

    from evidentia.plans import ORACLES, QUERIES

    from oracle import connection

    rng = random.Random(5)
    ends = [datetime(2024, 1, 4) + timedelta(days=7 * i) for i in range(3)]
    times = [datetime(2024, 1, 1) + timedelta(seconds=rng.uniform(0, 17 * 86_400 - 10)) for _ in range(600)]
    times += [end + timedelta(milliseconds=rng.choice([-900, -501, -500, -499, -1, 0, 1])) for end in ends[:2] for _ in range(20)] + [ends[2], None, datetime(2024, 1, 2)]
    rows = [(n, at, rng.choice([0, 1, 9]), rng.choice(["error", "click", "click", "view", None]), 1.0, rng.choice(['{"k": 3}', None])) for n, at in enumerate(times)]
    rows[-1], rows[-3] = (None, times[-1], 1, "click", 1.0, None), (642, times[-3], 1, "click", 1.0, None)
    rows += [(1000, times[0], None, "click", 1.0, None)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(str(tmp_path / "x"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "x").glob("*.parquet")).rename(tmp_path / "one" / "events.parquet")
    want = connection(tmp_path / "one").sql(ORACLES["str_04_stream"]).fetchall()
    assert {r[1] for r in want} == {int((end - datetime(1970, 1, 1)).total_seconds()) * 1000 for end in ends} and None in {r[2] for r in want}
    events.repartition(3).write.parquet(str(tmp_path / "many" / "events.parquet"))
    for folder in ("one", "many"):
        found = QUERIES["str_04_stream"](spark, str(tmp_path / folder)).select("user_id", "until", "event_id", "batch").collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
