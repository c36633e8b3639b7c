"""The commit log of batches: compare and set, replay, conflict, and what a batch reads."""

import pytest
from pyspark.sql import functions as F

from evidentia.streaming.receipts import KEY, PARTS, Ledger, Reused, Stale

SCHEMA = "source string, source_id string, revision string, text string"


def test_checkpoints_move_by_compare_and_set(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    batch = lambda *rows: spark.createDataFrame([("s", i, "1", t) for i, t in rows], SCHEMA)
    assert ledger.commit(batch(("1", "a"), ("2", "b"), ("2", "b")), "c", "s", None, "1") == {"replayed": False, "added": 2, "repeated": 0, "conflicts": 0}
    # The same again, in another order: nothing is added, and the outcome is told.
    assert ledger.commit(batch(("2", "b"), ("1", "a"), ("2", "b")).repartition(3), "c", "s", None, "1") == {"replayed": True, "added": 2, "repeated": 0, "conflicts": 0}
    with pytest.raises(Reused):
        ledger.commit(batch(("1", "other")), "c", "s", None, "1")
    with pytest.raises(Stale):
        ledger.commit(batch(("3", "c")), "c", "s", None, "2")
    with pytest.raises(ValueError):
        ledger.commit(spark.createDataFrame([("t", "1", "1", "a")], SCHEMA), "c", "s", "1", "2")
    assert ledger.checkpoint("c", "s").cursor == "1"
    assert ledger.commit(batch(("1", "a"), ("2", "changed"), ("3", "c"), (None, "n")), "c", "s", "1", "2") == {"replayed": False, "added": 2, "repeated": 1, "conflicts": 1}
    # Another sender has a checkpoint of its own, and a batch without rows moves it.
    assert ledger.commit(batch(("9", "x")).limit(0), "d", "s", None, "7")["added"] == 0
    assert ledger.commit(batch((None, "n")), "d", "s", "7", "8") == {"replayed": False, "added": 0, "repeated": 1, "conflicts": 0}
    assert (ledger.checkpoint("c", "s").cursor, ledger.checkpoint("d", "s").cursor, ledger.checkpoint("e", "s")) == ("2", "8", None)
    assert ledger.parts.figure("records") == 4


def test_a_batch_that_breaks_off_leaves_nothing(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "l"))
    rows = spark.createDataFrame([("s", "1", "1", "a")], SCHEMA)
    real = ledger.parts.commit
    monkeypatch.setattr(ledger.parts, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError()))
    with pytest.raises(OSError):
        ledger.commit(rows, "c", "s", None, "1")
    monkeypatch.setattr(ledger.parts, "commit", real)
    assert ledger.checkpoint("c", "s") is None
    assert ledger.commit(rows, "c", "s", None, "1") == {"replayed": False, "added": 1, "repeated": 0, "conflicts": 0}


def test_files_read_stay_constant(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), merge=3)
    files = []
    for n in range(10):
        rows = spark.range(20 * n, 20 * n + 20).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"), F.lit("1").alias("revision"), F.lit("t").alias("text"))
        ledger.commit(rows, "c", "s", str(n - 1) if n else None, str(n))
        probe = spark.createDataFrame([("s", "5", "1", "t")], SCHEMA).withColumn("part", F.pmod(F.xxhash64(*KEY), F.lit(PARTS)).cast("int"))
        files.append(ledger.known(probe).select(F.input_file_name().alias("f")).distinct().count())
    assert max(files) <= 4 and ledger.parts.figure("records") == 200
    assert ledger.commit(rows, "c", "s", "8", "9")["replayed"]
    again = ledger.commit(rows, "d", "s", None, "x")
    assert again == {"replayed": False, "added": 0, "repeated": 20, "conflicts": 0}
