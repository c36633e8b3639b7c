"""Canonical JSON of any nesting, its depth and its digest, as columns.

Canonical: object keys in rising order at every level, no blanks outside strings, strings with the shortest escapes, and
numbers as they were given. Spark's VARIANT parses, orders and writes; as it would write numbers anew, they go through it
as marked strings. Keys are ordered by UTF-16 units, as VARIANT does: apart from code point order where a character past
U+FFFF meets one from U+E000 on. A text that is no JSON, or repeats a key in one object, has no canonical form (null);
neither has null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A string, and a number outside of one; what VARIANT writes for a marked number and for a string that begins with the mark.
_STRING = r'"(?:[^"\\]|\\.)*"'
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_MARK = r"\u0001"
#: Control characters whose escapes have letters; the short ones have names of their own.
_LETTERED = [c for c in range(0x20) if f"{c:04x}" != f"{c:04X}" and chr(c) not in "\b\t\n\f\r"]

# Fixed value: the deepest nesting of a record's values.
MOST_DEPTH = 24


def _outside(text: Column) -> Column:
    """The stretches between a JSON text's strings, one more than there are strings."""
    return F.split(text, _STRING, -1)


def canonical(text: Column | str) -> Column:
    """The canonical form of a JSON text."""
    text = F.col(text) if isinstance(text, str) else text
    marked = F.transform(_outside(text), lambda s: F.regexp_replace(s, f"({_NUMBER})", r'"\\u0001$1"'))
    # A string that begins with the mark gets one more.
    strings = F.transform(F.regexp_extract_all(text, F.lit(f"({_STRING})"), F.lit(1)), lambda s: F.regexp_replace(s, r'^"(?:\\u0001|\x01)', r'"\\u0001\\u0001'))
    joined = F.array_join(F.zip_with(marked, strings, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    # Raw control characters are no JSON, but VARIANT may take them; numbers such as 01 or 1. are none.
    written = F.to_json(F.try_parse_json(joined))
    plain = F.regexp_replace(F.regexp_replace(written, rf'"\\u0001({_NUMBER})"', "$1"), r'"\\u0001\\u0001', r'"\\u0001')
    for c in _LETTERED:
        plain = F.regexp_replace(plain, rf"(?<!\\)((?:\\\\)*)\\u{c:04X}", rf"$1\\u{c:04x}")
    return F.when(F.try_parse_json(text).isNotNull(), plain)


def depth(text: Column | str) -> Column:
    """How deep the deepest value of a JSON text lies: 0 for a scalar or an empty list, 1 for what that holds, and so on."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.array_join(_outside(text), "0"), r"\[\s*\]|\{\s*\}", "0")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.when(text.isNotNull(), F.aggregate(marks, start, step)["most"])


def digest(text: Column | str) -> Column:
    """The SHA-256 of a JSON text's canonical form."""
    return F.sha2(canonical(text).cast("binary"), 256)


def too_deep(text: Column | str, most: int = MOST_DEPTH) -> Column:
    """Whether a JSON text nests deeper than a record may, or is none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce((depth(text) > most) | F.try_parse_json(text).isNull(), F.lit(True))
