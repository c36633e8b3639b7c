"""Text functions: tokens, content terms, chunks, normal forms and digests."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: A token: letters and digits of any script.
TOKEN = r"[\p{L}\p{N}]+"
# Words that are no evidence of relevance.
STOP_WORDS = (
    "a an the is are was were be been being do does did have has had i me my mine we our you your it its this that "
    "these those what which who whom whose where when why how can could would should please tell about of for to in "
    "on at from with and or as now number type private much"
).split()
QUERY_TERMS = 32


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def query_terms(text: Column | str) -> Column:
    """The distinct ones of a query's first QUERY_TERMS tokens."""
    return F.array_distinct(F.slice(tokens(text), 1, QUERY_TERMS))


def content_terms(text: Column | str) -> Column:
    """Distinct case-folded tokens that are neither stop words nor digits only."""
    folded = F.regexp_extract_all(F.lower(F.replace(text, F.lit("ß"), F.lit("ss"))), F.lit(f"({TOKEN})"), F.lit(1))
    plain = F.filter(F.array_distinct(folded), lambda t: ~t.rlike(r"^\p{Nd}+$"))
    return F.array_except(plain, F.array(*map(F.lit, STOP_WORDS)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_terms(texts: pd.Series) -> pd.Series:
    """Content terms after compatibility normalisation (NFKC) and full case folding, sorted; null for null.

    Spark has no function for either, so this one runs in Python, on Arrow batches.
    """
    stop, token = set(STOP_WORDS), re.compile(r"[^\W_]+")

    def terms(text: str) -> list[str]:
        return sorted({t for t in token.findall(unicodedata.normalize("NFKC", text).casefold()) if t not in stop and not t.isdecimal()})

    return texts.map(terms, na_action="ignore")


def clauses(text: Column | str, most: int = 4) -> Column:
    """The first parts of a question between ?, ; and line ends, without blanks around them; empty ones are left out."""
    return F.slice(F.filter(F.transform(F.split(text, r"[?;\n]+"), lambda c: squeezed(c)), lambda c: c != ""), 1, most)


def halves(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and after the first mark; all of it and an empty text where there is none."""
    at = F.instr(text, mark)
    cut = lambda c, start, size: F.substring(c, start, size)
    return F.when(at > 0, cut(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, cut(text, at + len(mark), F.length(text))).otherwise("")


def squeezed(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def preview(text: Column | str, size: int = 2400) -> Column:
    return F.substring(text, 1, size)


def spans(text: Column | str, width: int = 2000, stride: int = 1800) -> Column:
    """Overlapping stretches of a text: array of (start, piece); an empty or null text has none."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))
    kept = F.filter(starts, lambda s: (s == 0) | (s + (width - stride) < n))
    made = F.transform(kept, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(width)).alias("piece")))
    return F.when(n > 0, made)


def email(address: Column | str) -> Column:
    """An address with its domain in lower case; null if there is no single @ with text on both sides."""
    clean = F.trim(address)
    at = F.length(clean) - F.length(F.replace(clean, F.lit("@"), F.lit("")))
    local, domain = F.substring_index(clean, "@", 1), F.substring_index(clean, "@", -1)
    return F.when((at == 1) & (local != "") & (domain != ""), F.concat(local, F.lit("@"), F.lower(domain)))


def phone(number: Column | str) -> Column:
    """An E.164 number without spaces, dots, hyphens and brackets; null if it is none."""
    bare = F.regexp_replace(number, r"[\s().-]", "")
    return F.when(bare.rlike(r"^\+[1-9][0-9]{6,14}$"), bare)


def literal_contains(text: Column | str, part: str) -> Column:
    """Whether text holds part, % and _ standing for themselves, blind to the case of A-Z and of no other letters."""
    folded = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.contains(folded(text), folded(F.lit(part)))


def digest(prefix: str, *parts: Column, size: int = 24) -> Column:
    """An id made of the SHA-256 of the parts' JSON array; nulls count as empty strings."""
    held = F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(held).cast("binary"), 256), 1, size))


def document(fields: dict[str, Column], most: int = 65_536) -> tuple[Column, Column]:
    """An object's JSON with its keys in order and no blanks, and whether it keeps to the size of a document.

    Maps among the fields are put in order too; null fields are left out.
    """
    text = F.to_json(F.struct(*(fields[name].alias(name) for name in sorted(fields))))
    return text, F.octet_length(text) <= most


def in_order(entries: Column) -> Column:
    """A map with its keys in rising order."""
    return F.map_from_entries(F.array_sort(F.map_entries(entries)))


def cosine(a: str, b: str) -> Column:
    """The cosine of two vectors of equal length; null where one is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
