"""Chat exports: a header line starts a message, lines without one go on with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx

#: Marks that some devices put into lines: of direction, and a narrow space before AM and PM.
DIRECTION, NARROW = "[\u200e\u200f]", "\u202f"
ORDERS = ("DMY", "MDY", "YMD")


def header(line: Column) -> Column:
    """What stands in a header line: its date's three numbers, its clock's two or three, AM or PM, and what is said; else null.

    Two forms are known: date and clock in square brackets, then the message; or date, clock, a dash between spaces, and
    the message. A comma may end the date. Which of the numbers is the year is not looked at, nor whether there is such a day.
    """
    inside, bracketed = F.substring(line, 2, 1 << 30), F.startswith(line, F.lit("["))
    (near, behind), (before, after) = tx.halves(inside, "]"), tx.halves(line, " - ")
    stamp = F.when(bracketed, F.when(F.contains(inside, F.lit("]")), near)).when(F.contains(line, F.lit(" - ")), before)
    said = F.ltrim(F.when(bracketed, behind).otherwise(after))
    date, clock = tx.halves(F.trim(stamp), " ")
    date, clock = F.rtrim(date, F.lit(",")), F.upper(F.trim(clock))
    half = F.when(F.endswith(clock, F.lit("AM")) | F.endswith(clock, F.lit("PM")), F.right(clock, F.lit(2))).otherwise("")
    clock = F.rtrim(F.substring(clock, F.lit(1), F.length(clock) - F.length(half)))
    days, times = F.split(date, "[./-]"), F.split(clock, ":")
    short = lambda parts, most: F.forall(parts, lambda p: F.length(p).between(1, most) & (F.translate(p, "0123456789", "") == ""))
    fits = (F.size(days) == 3) & short(days, 4) & F.size(times).isin(2, 3) & short(times, 2)
    return F.when(fits, F.struct(F.transform(days, lambda p: p.cast("int")).alias("days"), F.transform(times, lambda p: p.cast("int")).alias("times"), half.alias("half"), said.alias("said")))


def wall_time(days: Column, times: Column, half: Column, order: str) -> Column:
    """The local time of a header, null if it is none; years of two digits are from 1970 to 2069."""
    if order not in ORDERS:
        raise ValueError("the order of dates must be DMY, MDY or YMD")
    year, month, day = (F.get(days, order.index(c)) for c in "YMD")
    year = F.when(year >= 100, year).when(year < 70, year + 2000).otherwise(year + 1900)
    hour = F.get(times, 0)
    hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), None).otherwise(hour % 12 + F.when(half == "PM", 12).otherwise(0))
    return F.try_make_timestamp_ntz(year, month, day, hour, F.get(times, 1), F.coalesce(F.get(times, 2), F.lit(0)))


def instants(local: Column, zone: str, fold: int = 0) -> tuple[Column, Column, Column]:
    """The instant of a local time in a zone, whether clocks skip that time, and whether they show it twice.

    Of the two instants of a time that comes twice, fold 0 is the earlier. Clocks are taken to shift by an hour, and the
    session's time zone to be UTC.
    """
    at = F.to_utc_timestamp(local.cast("timestamp"), zone)
    back = lambda t: F.from_utc_timestamp(t, zone).cast("timestamp_ntz")
    hour = F.expr("INTERVAL 1 HOUR")
    early = F.when(back(at - hour) == local, at - hour).otherwise(at)
    late = F.when(back(at + hour) == local, at + hour).otherwise(at)
    return (late if fold else early), back(at) != local, early != late


def messages(lines: DataFrame, by: str = "path", order: str = "line_no", text: str = "line", dates: str = "DMY", zone: str = "UTC", fold: int = 0) -> DataFrame:
    """(path, message_no, sent_at, error, ambiguous, sender, namespace, address, text, ordinal) of export lines (path, line_no, line).

    Lines before a thread's first header belong to no message. sent_at is the instant of the local time; error says if
    that time does not exist, in the calendar or by the clocks of the zone. A message without a sender is the system's. An
    address that is a phone number is in normal form; other names count within their thread. ordinal counts equal
    messages (time, sender, text) of a thread from 0. A thread is read in the order of its lines. Null lines count as empty.
    """
    line = F.replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), DIRECTION, ""), F.lit(NARROW), F.lit(" "))
    marked = lines.select(F.col(by), F.col(order).alias("o"), line.alias("l")).withColumn("head", header(F.col("l")))
    number = F.sum(F.col("head").isNotNull().cast("int")).over(Window.partitionBy(by).orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    held = marked.withColumn("message_no", number).where("message_no > 0")
    entry = F.struct("o", F.coalesce("head.said", "l").alias("b"), F.col("head.days").alias("d"), F.col("head.times").alias("t"), F.col("head.half").alias("h"))
    whole = held.groupBy(by, "message_no").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    first = F.element_at("e", 1)
    said = whole.select(by, F.col("message_no").cast("long").alias("message_no"), wall_time(first["d"], first["t"], first["h"], dates).alias("local"), F.array_join(F.transform("e", lambda e: e["b"]), "\n").alias("said"))
    at, skipped, twice = instants(F.col("local"), zone, fold)
    sender, rest = tx.halves(F.col("said"), ": ")
    named = F.contains("said", F.lit(": "))
    error = F.when(F.col("local").isNull(), "no such date").when(skipped, "no such time in the zone")
    phone = tx.phone(sender)
    out = said.select(
        by,
        "message_no",
        F.when(error.isNull(), at).alias("sent_at"),
        error.alias("error"),
        F.coalesce(twice, F.lit(False)).alias("ambiguous"),
        F.when(named, sender).alias("sender"),
        F.when(named, F.when(phone.isNotNull(), "phone").otherwise(F.concat(F.lit("label:"), F.col(by).cast("string")))).alias("namespace"),
        F.when(named, F.coalesce(phone, sender)).alias("address"),
        F.when(named, rest).otherwise(F.col("said")).alias("text"),
    )
    same = Window.partitionBy(by, "sent_at", "sender", "text").orderBy("message_no")
    return out.withColumn("ordinal", (F.row_number().over(same) - 1).cast("long"))
