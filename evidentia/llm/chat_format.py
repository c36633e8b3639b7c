"""Chat formatting with a loss mask aligned by offsets.

A conversation is rendered whole: "### role: text</turn>\n" for each turn. In texts and roles a backslash goes before
every backslash, "#", "<" and (in roles) ":", so no control string can stand in a text and a reader undoes it exactly.
The rendering is encoded once with offsets; the spans of the assistant's texts, sorted, are intersected with the token
spans by binary search. The mask is that of the tokens; what lies under it is read back from the offsets.

Rows go to tasks by conversation and are streamed in order of turn (ties: role, then text; nulls first), so a task holds
no more than `flush` characters of a conversation (or one longer turn): beyond, what has come is rendered and encoded, and
digests go on. Shorter conversations, of up to FLUSH characters by default, are encoded once and whole. Null roles count as empty strings, null texts as empty. A null conv_id is a conversation of its own. A
conversation without rows gives none; repeated rows are turns of their own. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"
FLUSH = 4 << 20
_TEXT_ESCAPE, _ROLE_ESCAPE, _ESCAPED = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_ESCAPE if role else _TEXT_ESCAPE).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns (role, text), and the spans of the trained role's escaped texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, True)}{SEPARATOR}", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendering."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return out


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens overlap a span, and the stretches of text under these tokens within the spans, in order.

    offsets: (tokens, 2), both columns rising; spans: sorted and apart.
    """
    mask, stretches = np.zeros(len(offsets), bool), []
    starts, ends = offsets[:, 0], offsets[:, 1]
    for a, b in spans:
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if first >= last or a == b:
            continue
        mask[first:last] = True
        lo, hi = np.maximum(starts[first:last], a), np.minimum(ends[first:last], b)
        lo = np.maximum(lo, np.concatenate([[a], np.maximum.accumulate(hi)[:-1]]))
        for s, e in zip(lo.tolist(), hi.tolist(), strict=True):
            if e > s:
                if stretches and stretches[-1][1] == s and s > a:
                    stretches[-1] = (stretches[-1][0], e)
                else:
                    stretches.append((s, e))
    return mask, stretches


_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer, processors

        held = Tokenizer.from_file(path)
        held.encode_special_tokens = True
        held.post_processor = processors.ByteLevel(trim_offsets=False)
        _TOKENIZERS[path] = held
    return _TOKENIZERS[path]


class _Conversation:
    """Figures of one conversation, gathered from its output stretch by stretch."""

    def __init__(self, key, tokenizer, with_output: bool, most: int):
        self.key, self.tokenizer, self.held, self.size, self.most = key, tokenizer, [], 0, most
        self.turns = self.loss_chars = self.chars = self.tokens = self.loss_tokens = 0
        self.read, self.loss = hashlib.sha256(), hashlib.sha256()
        self.with_output, self.texts, self.ids, self.mask = with_output, [], [], []

    def add(self, role: str, text: str) -> None:
        self.held.append((role, text))
        self.size += len(text)
        if self.size > self.most:
            self.flush()

    def flush(self) -> None:
        formatted, spans = render(self.held)
        encoded = self.tokenizer.encode(formatted, add_special_tokens=False)
        mask, stretches = loss_mask(np.array(encoded.offsets, np.int64).reshape(-1, 2), spans)
        for role, text in parse(formatted):
            self.read.update(f"{role}\n{text}\n".encode())
            self.turns += 1
        for a, b in stretches:
            part = unescape(formatted[a:b])
            self.loss.update(part.encode())
            self.loss_chars += len(part)
        self.chars += len(formatted)
        self.tokens += len(mask)
        self.loss_tokens += int(mask.sum())
        if self.with_output:
            self.texts.append(formatted)
            self.ids.extend(encoded.ids)
            self.mask.extend(mask.tolist())
        self.held, self.size = [], 0

    def row(self) -> tuple:
        self.flush()
        own = (self.key, self.turns, self.read.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens, self.loss_tokens)
        return (*own, "".join(self.texts), self.ids, self.mask) if self.with_output else own


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
_OUTPUT = ", formatted string, input_ids array<int>, loss_mask array<boolean>"


def formatted(conversations: DataFrame, tokenizer_path: str, with_output: bool = True, flush: int = FLUSH) -> DataFrame:
    """One row for each conversation: figures read back from its output and, with_output, the output itself."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()] + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())] * with_output
    names = [part.split()[0] for part in (_DIGEST + _OUTPUT * with_output).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, now, done = _tokenizer(tokenizer_path), None, []

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done.clear()
            return out

        for batch in batches:
            for key, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(key, tokenizer, with_output, flush)
                now.add(role or "", text or "")
                if len(done) >= 256:
                    yield made()
        if now is not None:
            done.append(now.row())
        if done:
            yield made()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, _DIGEST + _OUTPUT * with_output)
