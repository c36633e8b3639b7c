"""Column functions on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from evidentia.functions import rules, text as tx
from evidentia.schema import validated


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_stop_words_and_numbers_are_no_evidence(spark):
    terms = lambda s: set(one(spark, tx.content_terms(F.lit(s))))
    assert not terms("What is my blood type?") & terms("My office is here. The phone number changed in 2023.")
    assert terms("Where was my office in 2023?") & terms("My office is River Road.")
    assert terms("Straße STRASSE") == {"strasse"}
    assert one(spark, tx.content_terms(F.lit(None).cast("string"))) is None


def test_gate(spark):
    gate = lambda n, s: one(spark, rules.accepted(F.lit(n), F.lit(s).cast("double")))
    assert gate(0, 0.8) and gate(1, None) and gate(0, 0.5)
    assert not gate(0, 0.2) and not gate(0, None)


def test_quiet_hours(spark):
    quiet = lambda t, a, b: one(spark, rules.quiet(F.to_timestamp(F.lit(f"2024-01-01 {t}")), a, b))
    assert quiet("23:00:00", "22:00", "07:00") and quiet("06:59:00", "22:00", "07:00")
    assert not quiet("07:00:00", "22:00", "07:00") and quiet("12:00:00", "09:00", "09:00")
    assert quiet("09:00:00", "09:00", "10:00") and not quiet("10:00:00", "09:00", "10:00")


def test_novelty_and_attention(spark):
    now = F.to_timestamp(F.lit("2024-01-10 00:00:00"))

    def novelty(role, hint, at):
        return one(spark, rules.novelty(F.lit(role), F.lit(hint).cast("string"), F.to_timestamp(F.lit(at).cast("string")), now))

    assert novelty("incremental", "fresh", "2024-01-09 00:00:00") == "live"
    assert novelty("incremental", "fresh", None) == "uncertain"
    assert novelty("incremental", "fresh", "2024-01-12 00:00:00") == "uncertain"
    assert novelty("incremental", None, "2024-01-09 00:00:00") == "uncertain"
    assert novelty("backfill", None, None) == "historical" and novelty("reconcile", None, None) == "recovered"
    assert novelty("incremental", "historical", None) == "historical"
    decide = lambda kind, novel, origin, purpose: one(spark, rules.attention(F.lit(kind), F.lit(novel), F.lit(origin), purpose))
    assert decide("created", "live", "incremental", "foreground") == "next_turn"
    assert decide("created", "uncertain", "incremental", "background") == "background_digest"
    assert decide("created", "live", "derived", "foreground") == "record_only"
    assert decide("metadata_updated", "live", "incremental", "foreground") == "record_only"
    assert decide("backfill_complete", "historical", "incremental", "background") == "background_digest"


def test_units_recency_and_identity(spark):
    unit = lambda m, u, v: one(spark, rules.canonical(F.lit(m), F.lit(u), F.lit(v)))
    assert unit("mass", "g", 70000.0) == 70.0 and abs(unit("temperature", "F", 98.6) - 37) < 1e-9
    assert unit("mass", "stone", 1.0) is None
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    assert one(spark, rules.recency(F.lit(0.5), F.lit(None).cast("timestamp"), now)) == 0.5
    assert one(spark, rules.recency(F.lit(0.5), F.to_timestamp(F.lit("2023-01-01 00:00:00")), now)) == 0.75
    assert one(spark, tx.phone(F.lit("+44 7700 900123"))) == one(spark, tx.phone(F.lit("+447700900123"))) == "+447700900123"
    assert one(spark, tx.phone(F.lit("12"))) is None
    assert one(spark, tx.email(F.lit(" A.b@Example.COM "))) == "A.b@example.com" and one(spark, tx.email(F.lit("a@b@c"))) is None


def test_spans(spark):
    made = lambda s, w, n: [tuple(x) for x in one(spark, tx.spans(F.lit(s), w, n)) or []]
    assert made("abcdefghij", 4, 3) == [(0, "abcd"), (3, "defg"), (6, "ghij")]
    assert made("abc", 4, 3) == [(0, "abc")] and made("", 4, 3) == []


def test_contract(spark):
    from evidentia.schema import RECORD

    good = {"schema_version": "1.0", "source": "s", "source_id": "1", "revision": "1", "kind": "k", "observed_at": "2024-01-01T00:00:00Z", "text": "t", "provenance": {"origin": "source"}}
    bad = good | {"observed_at": "2024-01-01T00:00:00", "text": " ", "provenance": {"origin": "derived", "parent_record_ids": []}}
    rows = validated(spark.createDataFrame([good, bad], RECORD)).collect()
    assert rows[0].valid and rows[0].errors == []
    assert set(rows[1].errors) == {"text_missing", "observed_at", "parents_missing"}
