"""Secret scans: assignment, access-key and hex patterns, and windows of high Shannon entropy.

Candidate strings are the stretches of each character class (hex digits, letters and digits, base64) in runs of
[A-Za-z0-9+/_=-]: whole runs, what stands between equals signs, and the maximal stretches of the narrower classes, so
that a secret is judged by its own class and not by the name joined to it. Over each, for its narrowest class, the
entropy of a sliding window is kept up by adding the count terms of one character and taking off another's; a stretch any
of whose windows reaches its class's bound is a secret, if it mixes letters and digits and the allow-list does not
suppress it. Of nested ones the longest counts. The allow-list looks at the stretch: what follows a digest or a name with
"example" is judged on its own. Stretches of letters only must change case as often as random ones do, with more entropy,
so that words and names in camel case are left alone. What comes behind the last "example" is judged with and without what
joins it. The patterns' own findings always stay.

Null and empty texts have no spans. Whole texts of any length are scanned. Spans are in code points, end exclusive.
Repeated rows give a row each; an empty table gives none. Columns named like those that are made here (MADE) are
replaced; other extra columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import widened

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}")
WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{20,}(?![A-Za-z0-9])")
SWITCH = re.compile(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])")
#: Least share of changes of case in letters only; random ones have a half, camel case some three tenths.
SWITCHES = 0.35
WINDOW = 20
#: Least entropy, in bits a character, of a window of each class.
BOUNDS = {"hex": 3.0, "alnum": 3.8, "base64": 3.8, "letters": 3.95}
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+\Z")), ("alnum", re.compile(r"[A-Za-z0-9]+\Z")), ("base64", re.compile(r"")))
#: Strings that look random and are no secrets: identifiers of content, of rows and of examples.
ALLOWED = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\Z|sha(?:1|256|384|512)[-_=]|.*example|/?(?:[a-z]+[0-9]{0,2}[-_/]+)+[a-z]*[0-9]{0,4}\Z|[0-9+/_=-]+\Z")

#: Listed strings that fill a whole run, and so everything in it.
WHOLE = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\Z|/?(?:[a-z]+[0-9]{0,2}[-_/]+)+[a-z]*[0-9]{0,4}\Z|[0-9+/_=-]+\Z")
#: A labelled digest, as hex or base64 of its size.
DIGEST = re.compile("(?i)(?<![a-z0-9])(?:" + "|".join(f"sha{bits}[-_=](?:[0-9a-f]{{{2 * size}}}(?![0-9a-f])|[a-z0-9+/_-]{{1,{-(-size // 3) * 4}}}=*)" for bits, size in ((1, 20), (256, 32), (384, 48), (512, 64))) + ")")
#: Names in camel case with short numbers between; of four characters three are small letters.
CAMEL = re.compile(r"[a-z]*(?:[A-Z][a-z]+|[0-9]{1,2})+\Z")
#: Share of neighbours that count up or down by one, from which a string is a sequence.
COUNTING = 0.8
NAME, JOINT, LETTER, DIGIT = re.compile(r"[A-Za-z0-9]*"), re.compile(r"[+/_=-]*"), re.compile("[A-Za-z]"), re.compile("[0-9]")
STRETCHES = (re.compile(r"[0-9a-fA-F]{20,}"), re.compile(r"[A-Za-z0-9]{20,}"), re.compile(r"[A-Za-z0-9+/_-]{20,}=*"))

MADE = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}
_TERM = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]
_MOST = math.log2(WINDOW)


def peak_entropy(text: str, window: int = WINDOW) -> float:
    """The greatest Shannon entropy, in bits, of the windows of text (of the whole of a shorter text)."""
    size = min(window, len(text))
    if not size:
        return 0.0
    counts: dict[str, int] = {}
    total = least = 0.0
    for i, char in enumerate(text):
        n = counts.get(char, 0)
        total += _term(n + 1) - _term(n)
        counts[char] = n + 1
        if i >= size:
            old = text[i - size]
            m = counts[old]
            total += _term(m - 1) - _term(m)
            counts[old] = m - 1
        if i == size - 1 or i >= size and total < least:
            least = total
    return math.log2(size) - least / size


def _term(n: int) -> float:
    return _TERM[n] if n <= WINDOW else n * math.log2(n)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index in KINDS) of the three patterns, sorted."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def examples(run: str) -> list[int]:
    """Where a run goes on behind its last "example": right behind it, and behind the last such name that more is joined to."""
    low = run.lower()
    last, joint = low.rfind("example"), max(map(run.rfind, "+/_=-"))
    found = [last + len("example")] if last >= 0 else []
    if (before := low.rfind("example", 0, max(joint, 0))) >= 0:
        found.append(JOINT.match(run, NAME.match(run, before).end()).end())
    return found


def camel(part: str) -> bool:
    return CAMEL.match(part) is not None and 4 * sum(not c.islower() for c in part) <= len(part)


def counting(part: str) -> bool:
    """Whether a string is mostly a sequence such as the alphabet."""
    steps = sum(abs(ord(b) - ord(a)) == 1 for a, b in zip(part, part[1:]))
    return steps >= COUNTING * (len(part) - 1)


def stretches(run: str) -> Iterator[tuple[int, int]]:
    """Bounds of the candidate strings of a run, the run itself first."""
    yield 0, len(run)
    if WHOLE.match(run):
        return
    digests = [m.span() for m in DIGEST.finditer(run)]
    for pattern in STRETCHES:
        for m in pattern.finditer(run):
            i = bisect_right(digests, (m.start(), len(run))) - 1
            if i < 0 or m.end() > digests[i][1]:
                yield m.span()
    # What follows a digest or an example, up to the next digest.
    for at in sorted({*(b for _, b in digests), *examples(run)}):
        i = bisect_right(digests, (at, 0))
        if i and at < digests[i - 1][1]:
            continue
        at = JOINT.match(run, at).end()
        for pattern in STRETCHES:
            if m := pattern.match(run, at, digests[i][0] if i < len(digests) else len(run)):
                yield m.span()


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, 3) of the candidate strings with a window of high entropy, in order."""
    found = []
    for m in CANDIDATE.finditer(text):
        run, reach = m.group(), 0
        # A stretch that holds another comes before it.
        for a, b in sorted(set(stretches(run)), key=lambda s: (s[0], -s[1])):
            part = run[a:b]
            if b <= reach or not (LETTER.search(part) and DIGIT.search(part)) or ALLOWED.match(part) or camel(part) or counting(part):
                continue
            kind = next(name for name, pattern in CLASSES if pattern.match(part))
            if peak_entropy(part) >= BOUNDS[kind]:
                found.append((m.start() + a, m.start() + b, 3))
                reach = b
    for m in WORD.finditer(text):
        part = m.group()
        if part[1:].islower() or len(SWITCH.findall(part)) < SWITCHES * (len(part) - 1) or ALLOWED.match(part):
            continue
        i = bisect_right(found, (m.start(), len(text), 3)) - 1
        if (i < 0 or found[i][1] < m.end()) and peak_entropy(part) >= BOUNDS["letters"]:
            insort(found, (m.start(), m.end(), 3))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """text with each maximal stretch of overlapping spans replaced by mark."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secrets(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 and spans; with redacted, its text has the spans replaced."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[list, list, list] = ([], [], [])
            digests, spans, texts = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                every = sorted(base + entropy_spans(text), key=lambda s: (s[0], s[2]))
                for k, column in enumerate(counts):
                    column.append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
                if redacted:
                    texts.append(redact(text, every) if every else value.as_py())
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if redacted:
                columns["text"] = pa.array(texts, pa.string())
            made = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns.values(), *made], names=[*columns, *MADE])

    kept = docs.withColumn("text", F.col("text").cast("string")).drop(*MADE)
    return kept.mapInArrow(scan, widened(kept, **MADE))
