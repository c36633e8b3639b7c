"""Readers of record files: JSON lines, typed measurements and mail."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Callable, Iterator
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import RECORD, instant, validated
from .html import plain

MEASUREMENT = "timestamp string, metric string, value string, unit string, id string, device string"
_MAIL = "path string, message_id string, sent_at string, subject string, senders array<string>, receivers array<string>, body string, marked boolean, attachments array<string>, error string"


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Contract records of JSON lines, with errors; blank lines are skipped and broken ones have every required field missing."""
    return validated(spark.read.schema(RECORD).option("mode", "PERMISSIVE").json(path))


def _typed(rows: DataFrame) -> DataFrame:
    amount = F.expr("try_cast(value as decimal(38, 18))")
    at = instant("timestamp")
    missing = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    error = F.when(amount.isNull(), "value").when(at.isNull(), "timestamp").when(missing("metric"), "metric").when(missing("unit"), "unit")
    return rows.select(at.alias("measured_at"), "metric", amount.alias("value"), "unit", "id", "device", error.alias("error"))


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of a measurement file with a header; `error` says what a rejected row lacks."""
    return _typed(spark.read.option("header", True).schema(MEASUREMENT).option("enforceSchema", False).csv(path))


def typed_lines(lines: DataFrame, line: str) -> DataFrame:
    """The same of measurement lines in a column."""
    return _typed(lines.select(F.from_csv(line, MEASUREMENT).alias("r")).select("r.*"))


def _mail(path: str, raw: bytes | None) -> tuple:
    if raw is None:
        return path, None, None, None, [], [], None, False, [], "no content"
    try:
        message = email.message_from_bytes(raw, policy=email.policy.default)
        sent = parsedate_to_datetime(message["Date"]) if message["Date"] else None
        if sent is not None and sent.tzinfo is None:
            return path, None, None, None, [], [], None, False, [], "date without zone"
        part = message.get_body(preferencelist=("plain", "html"))
        body, marked = (part.get_content(), part.get_content_subtype() == "html") if part is not None else ("", False)
        people = lambda *names: [a for n in names for _, a in getaddresses(message.get_all(n, [])) if a]
        files = [f"{a.get_filename() or ''};{a.get_content_type()}" for a in message.iter_attachments()]
        return path, message["Message-ID"], sent.isoformat() if sent else None, str(message["Subject"] or ""), people("From"), people("To", "Cc"), body, marked, files, None
    except (ValueError, LookupError, TypeError, AttributeError) as why:
        return path, None, None, None, [], [], None, False, [], type(why).__name__


def parsed_mails(raw: DataFrame, text: Callable[[Column], Column] = plain) -> DataFrame:
    """Mails of (path, content): headers and people in Python on Arrow batches, HTML bodies by expressions; other columns stay."""
    kept = [f for f in raw.schema.fields if f.name not in ("path", "content")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _MAIL.split(", ")]
        for frame in batches:
            read = pd.DataFrame([_mail(p, None if c is None else bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)], columns=names)
            yield read.assign(**{f.name: frame[f.name].array for f in kept})

    schema = ", ".join([_MAIL, *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])
    found = raw.select("path", "content", *(f.name for f in kept)).mapInPandas(run, schema)
    return found.withColumn("body", F.when(F.col("marked"), text(F.col("body"))).otherwise(F.col("body"))).drop("marked")


def mails(spark: SparkSession, path: str) -> DataFrame:
    """One row for each mail file: headers, plain text (else the HTML's), people and attachments; error where it can't be read."""
    return parsed_mails(spark.read.format("binaryFile").load(path).select("path", "content"))


def mailbox(spark: SparkSession, path: str) -> DataFrame:
    """One row for each message of mailbox files, which Spark splits at lines that begin with "From "."""
    pieces = spark.read.option("lineSep", "\nFrom ").text(path).select(F.input_file_name().alias("path"), "value")
    headed = F.regexp_replace(F.regexp_replace("value", r"^(?:From )?[^\n]*\n", ""), r"(?m)^>(>*From )", "$1")
    return parsed_mails(pieces.where(F.trim("value") != "").select("path", F.encode(headed, "UTF-8").alias("content")))
