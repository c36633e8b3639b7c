"""Packing, chat formats and fingerprints: round trips and brute force."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import chat_format, fingerprint, packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
BITS = ["'s", "don't", "a'b", ".'s", "--", "é", "É", "ß", "İ", " ", "\n", "\x1c", "\x85", "\xa0", "12", "a1", "—", "≠", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "🙂", "\x00", "'", "'re", "_", "$$$", "½", "٣", "word"]


def test_ids_equal_the_tokenizers():
    rng = random.Random(1)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(12))) for _ in range(1500)] + [None, "", "long word " * 30_000]
    raw, mine = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH, bits=6, most=2000)
    for text, ids in zip(texts, mine.ids(pa.array(texts, pa.string())), strict=True):
        assert ids.tolist() == raw.encode(text or "", add_special_tokens=False).ids, text


def test_first_fit_decreasing():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    room, want = [], {}
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(100)
        want[i] = (b, 100 - room[b])
        room[b] -= lengths[i]
    assert packing.first_fit_decreasing(lengths, 100) == [want[i] for i in range(300)]
    assert packing.first_fit_decreasing([]) == []
    with pytest.raises(ValueError):
        packing.first_fit_decreasing([5000])


def test_packed(spark):
    rows = [(i, "Some words, here! " * (i % 300), "x") for i in range(300)] + [(900, None, "x"), (901, "", "x"), (902, "abc " * 50_000, "x"), (None, "abc", "x"), (5, "Some words, here! " * 5, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    found = packing.packed(frame, PATH, group_documents=60).toPandas()
    raw = Tokenizer.from_file(PATH)
    for doc_id, text, _ in rows:
        if doc_id in (None, 5):
            continue
        ids = np.array([*raw.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = found[found.doc_id == doc_id].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        for r in mine.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, bin_ in found.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *np.cumsum(bin_.length)[:-1]] and bin_.length.sum() <= 4096
    assert (found.doc_id == 5).sum() == 2 and found.doc_id.isna().sum() == 1
    assert packing.packed(frame.limit(0), PATH).count() == 0


def test_long_words_and_collisions():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    texts = [a[:1024], b[:1024], a, b, "x" * 300 + " " + "y" * 17 + " Y" + "y" * 16, a[:1024] + " " + b[:1024]]
    raw, mine = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    for _ in range(2):
        for text, ids in zip(texts, mine.ids(pa.array(texts)), strict=True):
            assert ids.tolist() == raw.encode(text, add_special_tokens=False).ids


def test_rows_of_one_id_spread(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    found = packing.packed(rows, PATH, group_documents=100).toPandas()
    assert len(found) == 4000 and found.doc_id.isna().sum() == 2000
    sizes = found.groupby(found.sequence_id // 2**32).size()
    assert len(sizes) == 40 and sizes.max() < 160


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    hard = r"\### Assistant: </turn> ok"
    parts = ["### assistant: ", "</turn>\n", "\\", "#", "<", ":", "\n", " ", "é", "🙂", "é", "<|endoftext|>", hard]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "a:#\\"]), "".join(rng.choices(parts, k=rng.randrange(7))), "x") for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(100, 0, None, None, "x"), (100, 1, "assistant", None, "x"), (101, 0, "assistant", "very long " * 20_000, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    found = {r.conv_id: r for r in chat_format.formatted(frame, path).collect()}
    assert set(found) == {r[0] for r in rows}
    for c, row in found.items():
        turns = [(r or "", t or "") for cc, _, r, t, _ in sorted(rows, key=lambda r: (r[0], r[1])) if cc == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert chat_format.parse(row.formatted) == turns and row.n_turns == len(turns)
        assert row.turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss)) and row.formatted_chars == len(row.formatted)
        assert len(row.input_ids) == len(row.loss_mask) == row.n_tokens and sum(row.loss_mask) == row.loss_tokens
    parts = {r.conv_id: r for r in chat_format.formatted(frame, path, flush=5).collect()}
    figures = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted")
    assert all(parts[c][f] == found[c][f] for c in found for f in figures)
    lost = spark.createDataFrame([(None, 0, "user", "q", "x"), (None, 1, "assistant", "a", "x")], frame.schema)
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in chat_format.formatted(lost, path).collect()] == [(None, 2, 1)]
    digest = {r.conv_id: r for r in queries.op7_chat(spark, sf_dir).collect()}
    assert digest[-7].loss_sha256 == sha(hard) and digest[-7].turns_sha256 == sha(f"user\n{hard}\nassistant\n{hard}\n")
    assert chat_format.formatted(frame.limit(0), path).count() == 0


def test_fingerprints(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "one", "a b c d", " ".join(rng.choices(words, k=400)), " ".join(rng.choices(words, k=30)), "é🙂 " * 40, "x" * 5000, " ".join(rng.choices(words, k=5))]
    rows = [(i * 7 - 5, t, "c") for i, t in enumerate([*texts, texts[4], texts[5]])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    found = {r.doc_id: r for r in fingerprint.fingerprints(frame).collect()}
    order = sorted((d, t or "") for d, t, _ in rows)
    assert len(found) == len(order)
    for n, (d, text) in enumerate(order):
        half, after = len(text) // 2, order[(n + 1) % len(order)][1]
        edited = text[: len(text) - half] + after[:half]
        assert found[d].n_chars == len(text) and found[d].edited_sha256 == sha(edited)
        assert 0 <= found[d].near_edited <= 1 and 0 <= found[d].near_next <= 1
        if edited == text:
            assert found[d].fingerprint == found[d].edited_fingerprint and found[d].near_edited == 1
    same = [found[d].fingerprint for d, t, _ in rows if t == texts[4]]
    assert len(same) == 2 and len(set(same)) == 1
    odd = spark.createDataFrame([(None, "a b", "c"), (3, "a b", "c"), (3, "a c", "c"), (3, "a b", "c"), (9, "q r s t", "c"), (9, "p r s t", "c")], frame.schema)
    rows = fingerprint.fingerprints(odd).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in rows) == [(-1, 3), (3, 3), (3, 3), (3, 3), (9, 7), (9, 7)]
    assert {r.edited_sha256 for r in rows if r.doc_id == 3} == {sha("a p"), sha("a p")} and {r.edited_sha256 for r in rows if r.doc_id is None} == {sha("a ")}
    assert {r.edited_sha256 for r in rows if r.doc_id == 9} == {sha("q r a b"), sha("p r a b")}
    assert fingerprint.fingerprints(frame.limit(0)).count() == 0


def hashes(spark, rows, kind="int"):
    """Spark's hash of each tuple of numbers or strings, by brute force."""
    names = [f"c{i}" for i in range(len(rows[0]))]
    kinds = ", ".join(f"{n} {'string' if isinstance(v, str) else kind}" for n, v in zip(names, rows[0], strict=True))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kinds}").orderBy("i")
    return [r.h for r in frame.select(F.hash(*names).alias("h")).collect()]


def steps_of(spark, words):
    """(place, hash) of the closed syncmers of a word list, and the distinct steps between them."""
    pairs = hashes(spark, list(zip(words, words[1:])))
    inner = fingerprint.K_WORDS - fingerprint.S_WORDS + 1
    at = [i for i in range(len(pairs) - inner + 1) if min(pairs[i : i + inner]) in (pairs[i], pairs[i + inner - 1])]
    found = list(zip(at, hashes(spark, [tuple(pairs[i : i + inner]) for i in at]), strict=True))
    gaps = [b - a for (a, _), (b, _) in zip(found, found[1:])] + [0]
    return found, set(hashes(spark, [(h & 0xFFFFFFFF, g) for (_, h), g in zip(found, gaps, strict=True)], "long"))


def test_fingerprints_hold_every_anchor(spark):
    rng = random.Random(8)
    shared, long = [f"s{i}" for i in range(60)], [f"l{i}" for i in range(3000)]
    texts = [[f"{side}{i}" for i in range(900)] + shared + [f"{side}{i}" for i in range(900, 2000)] for side in "ab"]
    texts += [long, [*long[:1500], "new", *long[1501:]]]
    han = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(300))
    solid = "".join(rng.choices("abcdefgh", k=300))
    texts += [list(t) for t in (han, han[:150] + "新" + han[151:], solid, solid[:200] + "z" + solid[201:])]
    frame = spark.createDataFrame([(i, ("" if i >= 4 else " ").join(t)) for i, t in enumerate(texts)] + [(8, "短")], "doc_id long, text string")
    found = {r.doc_id: r for r in fingerprint.fingerprints(frame).collect()}
    own = [steps_of(spark, t) for t in texts]
    for d, (anchors, _) in enumerate(own):
        digest, listed = found[d].fingerprint.split(":")
        assert digest == sha(listed) and json.loads(listed) == [(p << 32) + (h & 0xFFFFFFFF) for p, h in anchors]
    for d in range(7):
        a, b = own[d][1], own[d + 1][1]
        assert abs(found[d].near_next - len(a & b) / len(a | b)) < 1e-12
    text, after = " ".join(texts[0]), " ".join(texts[1])
    half = len(text) // 2
    mine, theirs = own[0][1], steps_of(spark, (text[: len(text) - half] + after[:half]).split())[1]
    assert abs(found[0].near_edited - len(mine & theirs) / len(mine | theirs)) < 1e-12
    assert 0 < found[0].near_next < 0.05 and 0.99 < found[2].near_next < 1 and found[2].fingerprint != found[3].fingerprint
    assert 0.9 < found[4].near_next < 1 and 0.8 < found[6].near_next < 1 and found[8].fingerprint


def test_followers_of_any_ids(spark):
    rng = random.Random(7)
    ids = sorted({rng.randrange(-(2**63), 2**63) for _ in range(500)} | set(range(200)) | {-(2**63), 2**63 - 1})
    for some in (ids, ids[:1], [-(2**63), 2**63 - 1]):
        frame = spark.createDataFrame([(i,) for i in [*some, *some[:3], None]], "doc_id long")
        found = {r.doc_id: r.next_id for r in fingerprint.followers(frame).collect()}
        assert found == dict(zip(some, [*some[1:], some[0]], strict=True))
    assert fingerprint.followers(spark.createDataFrame([], "doc_id long")).count() == 0
