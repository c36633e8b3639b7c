"""License scans: Aho-Corasick over word sequences for phrases and tags, shunting-yard for licence expressions.

A text becomes its words (A-Z lower-cased; ASCII letters and digits and all non-ASCII characters) between single spaces;
one automaton finds every phrase, on word bounds, in one pass. Where the words of the identifier tag stand, the
expression after it is read from the text itself, turned into postfix form (WITH binds closest, then AND, then OR) and
evaluated: its licences become labels, each once, with the exception that WITH gives it. Tag lines are read whole and
AND and OR are not multiplied out, so an expression of any length costs time in proportion. What is no known identifier
counts as a licence only if it looks like one (a digit or hyphen in it, or LicenseRef-); NONE and NOASSERTION name none.
Sentences that several licences share label a text only together with another that tells which one it is. Several
licences in a text are all named, with no order or preference among them.

The score is the chance that some finding is right, 1 - product of (1 - trust), over distinct kinds of findings. Null
and empty texts have no words and score 0. Whole texts of any length are scanned. Repeated rows give a row each; an empty
table gives none; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices that name or quote a licence, and their labels.
NOTICES = {
    "academic free license": "afl",
    "affero general public license": "agpl",
    "all rights reserved": "all-rights-reserved",
    "artistic license": "artistic",
    "beerware license": "beerware",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "business source license": "busl",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "cecill license": "cecill",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "eclipse distribution license": "edl",
    "eclipse public license": "epl",
    "educational community license": "ecl",
    "elastic license": "elastic",
    "european union public licence": "eupl",
    "free documentation license": "gfdl",
    "general public licence": "gpl",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "licensed under the mit": "mit",
    "microsoft public license": "ms-pl",
    "microsoft reciprocal license": "ms-rl",
    "mozilla public license": "mpl",
    "mulan permissive software license": "mulanpsl",
    "open data commons attribution license": "odc-by",
    "open database license": "odbl",
    "open government licence": "ogl",
    "open software license": "osl",
    "postgresql license": "postgresql",
    "public domain dedication": "public-domain",
    "python software foundation license": "psf",
    "released into the public domain": "public-domain",
    "server side public license": "sspl",
    "sil open font license": "ofl",
    "sleepycat license": "sleepycat",
    "the unlicense": "unlicense",
    "this is free and unencumbered software": "unlicense",
    "university of illinois ncsa open source license": "ncsa",
    "universal permissive license": "upl",
    "w3c software notice and license": "w3c",
    "zlib license": "zlib",
    "zope public license": "zpl",
}
# Sentences that several licences share, which name one only where all of a row stand in a text.
SHARED = (
    (
        "bsd",
        "redistribution and use in source and binary forms",
        "provided by the copyright holders and contributors as is",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms",
        "provided by the regents and contributors as is",
    ),
    (
        "bsl",
        "permission is hereby granted free of charge",
        "machine executable object code generated by a source language processor",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software",
        "the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mit",
        "permission is hereby granted free of charge",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
)
# Identifiers of licences, in lower case.
IDENTIFIERS = frozenset(
    (
        "0bsd afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 "
        "beerware bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 cc-by-3.0 cc-by-4.0 "
        "cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 "
        "cpl-1.0 curl ecl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.2 ftl gfdl-1.3 gpl-1.0 gpl-2.0 gpl-2.0-only "
        "gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd ijg isc json lgpl-2.0 lgpl-2.1 lgpl-2.1-only "
        "lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl "
        "mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby "
        "sleepycat tcl unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1"
    ).split()
)
TAG = "spdx license identifier"
TAG_TEXT = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]+)", re.IGNORECASE)
TRUST = {"base": 0.8, "notice": 0.6, "tag": 0.95}

_SPACED = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9.+:-]+)")
_BINDS = {"or": 1, "and": 2, "with": 3}
_SHAPE = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+\Z|(?=[a-z0-9.+-]*[0-9-])(?=[a-z0-9.+-]*[a-z])[a-z0-9][a-z0-9.+-]*\Z")
_NONE = ("none", "noassertion")


def is_licence(word: str) -> bool:
    return word in IDENTIFIERS or word.rstrip("+") in IDENTIFIERS or word in _NONE or bool(_SHAPE.match(word))


def postfix(text: str) -> list[str] | None:
    """A licence expression in postfix form; text after a whole expression is ignored, None if none begins the text.

    WITH takes one name, and stands after a licence or a bracket.
    """
    out: list[str] = []
    waiting: list[str] = []
    opened, want, named, done = 0, True, False, None
    for m in iter(_TOKEN.scanner(text).match, None):
        token = m.group(1)
        word = token.lower()
        if want and token == "(" and not named:
            waiting.append("(")
            opened += 1
        elif want and token not in "()" and word not in _BINDS and (named and re.match("[a-z0-9]", word) or is_licence(word)):
            out.append(word)
            want = named = False
        elif not want and token == ")" and opened:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            opened -= 1
        elif not want and word in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                out.append(waiting.pop())
            waiting.append(word)
            want, named = True, word == "with"
        else:
            break
        if not want and not opened:
            done = len(out), waiting[::-1]
    return out[: done[0]] + done[1] if done else None


def evaluate(form: list[str]) -> tuple[list[str], str]:
    """The licences of a postfix expression, each once with its exception, and the expression written out.

    An exception goes to every licence before it that has none. The stack holds places in the list of licences, so
    nothing is multiplied out.
    """
    names: list[list[str]] = []
    stack: list[tuple[int, int, list]] = []
    for token in form:
        if token not in _BINDS:
            names.append([token])
            stack.append((len(names) - 1, 0, [token]))
            continue
        (at, _, right), (first, binds, left) = stack.pop(), stack.pop()
        if token == "with":
            exception = names.pop()[0]
            for name in names[first:]:
                if len(name) == 1:
                    name.append(exception)
        here = _BINDS[token]
        side = lambda part, own: ["(", part, ")"] if own and own < here else part
        stack.append((first, here, [side(left, binds), f" {token} ", side(right, _)]))
    found = dict.fromkeys(" with ".join(name) for name in names if name[0] not in _NONE)
    return list(found), _written(stack[0][2])


def _written(tree: list) -> str:
    out, left = [], [tree]
    while left:
        part = left.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            left.extend(reversed(part))
    return "".join(out)


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    every: dict[str, list[tuple[str, str]]] = {}
    shared = {phrase: phrase for _, *phrases in SHARED for phrase in phrases}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("shared", shared), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            every.setdefault(phrase, []).append((kind, label))
    for phrase, means in every.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, means))
    found.make_automaton()
    return found


def scan(text: bytes, automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expression)."""
    words = text.translate(_SPACED).split()
    spaced = f" {b' '.join(words).decode()} "
    base, labels, kinds, shared, expression = [], set(), set(), set(), None
    seen = counted = 0
    starts = sorted(((end + 1 - size, means) for end, (size, means) in automaton.iter(spaced)), key=lambda s: s[0])
    for start, means in starts:
        seen += spaced.count(" ", counted, start)
        counted = start
        for kind, label in means:
            if kind == "shared":
                shared.add(label)
                continue
            kinds.add(kind)
            if kind == "base":
                base.append((seen, label))
            if label:
                labels.add(label)
    for label, *phrases in SHARED:
        if shared.issuperset(phrases):
            kinds.add("notice")
            labels.add(label)
    if "tag" in kinds:
        kinds.discard("tag")
        for m in TAG_TEXT.finditer(text.decode()):
            if form := postfix(m.group(1)):
                licences, written = evaluate(form)
                kinds.add("tag")
                labels.update(licences)
                expression = expression or written
    doubt = 1.0
    for kind in kinds:
        doubt *= 1 - TRUST[kind]
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), 1 - doubt, expression


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expression) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expression"]
        for batch in batches:
            rows = [scan(value.as_py() or b"", automaton) for value in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string"
    )
