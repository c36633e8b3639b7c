"""Classifiers: held-out accuracy, and rows that nothing can be learnt from."""

import duckdb
import numpy as np

from evidentia.llm import language, quality, queries, toxicity
from evidentia.llm.common import fold_of_py

MIDDLE = "/root/testdata/sf0.1"
KIND = "doc_id long, text string, lang string, score double, tox_score string"


def labelled(column):
    return dict(duckdb.execute(f"SELECT doc_id, {column} FROM '{MIDDLE}/labels.parquet'").fetchall())


def held_out(rows, truth, folds, fold):
    return [(r, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None and fold_of_py(r.doc_id, folds) == fold]


def test_toxicity(spark):
    pairs = held_out(queries.op3_toxicity(spark, MIDDLE).collect(), labelled("toxic"), 5, 0)
    assert len(pairs) > 500 and np.mean([r.predicted == y for r, y in pairs]) > 0.95
    assert np.mean([r.predicted for r, y in pairs if y == 1]) > 0.7


def test_quality(spark):
    pairs = held_out(queries.op8_quality(spark, MIDDLE).collect(), labelled("quality"), 5, 0)
    assert len(pairs) > 500 and np.mean([r.predicted == y for r, y in pairs]) > 0.98


def test_language(spark):
    truth = dict(duckdb.execute(f"SELECT doc_id, lang FROM '{MIDDLE}/documents.parquet'").fetchall())
    pairs = held_out(queries.op5_language(spark, MIDDLE).collect(), truth, 4, 2)
    assert len(pairs) > 2000 and np.mean([r.lang_pred == y for r, y in pairs]) > 0.97


def test_odd_rows(spark):
    rows = [(1, None, "en", 0.5, "x"), (2, "", "en", 0.5, "x"), (3, "123 !!", None, 0.5, "x"), (4, "the words " * 4000, "en", 0.5, "x"), (4, "the words", "en", 0.5, "x"), (None, "mots é", "fr", 0.5, "x")]
    docs = spark.createDataFrame(rows, KIND)
    labels = spark.createDataFrame([(4, 1, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    tox = toxicity.toxicity(docs, labels)
    assert tox.count() == 6 and all(0 <= r.tox_score <= 1 for r in tox.collect())
    assert all(0 <= r.score <= 1 for r in quality.quality(docs, labels).collect())
    lang = {(r.doc_id, r.lang_pred) for r in language.languages(docs, docs).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "en")} <= lang
    for frame in (toxicity.toxicity(docs, labels.limit(0)), quality.quality(docs, labels.limit(0)), language.languages(docs, docs.limit(0))):
        assert frame.count() == 6
    for frame in (toxicity.toxicity(docs.limit(0), labels), quality.quality(docs.limit(0), labels), language.languages(docs.limit(0), docs)):
        assert frame.count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=1 << quality.BITS), rng.normal(size=(1 << quality.BITS, quality.RANK))
    at, x = np.array([3, 9, 500]), np.array([1.0, 0.5, 2.0])
    pairs = sum(v[at[i]] @ v[at[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert abs(quality.raw_score((0.1, w, v), at, x) - (0.1 + w[at] @ x + pairs)) < 1e-9


def test_quality_by_brute_force(spark):
    """Scores of a small table from the fitted model, with every pair of features summed one by one."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    rows = [(i, ("Fine prose about rivers. " if i % 3 else "BUY $$$ NOW!!! ") * (1 + i % 4) + f"w{i % 7}", int(i % 3 > 0)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    found = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    order = [r.doc_id for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").collect()]
    features = dict(zip((i for i, *_ in rows), quality._rows(pa.array([t for _, t, _ in rows])), strict=True))
    truth = {i: y for i, _, y in rows}
    given = [(features[i][0].astype("<i4"), features[i][1].astype("<f4")) for i in order]
    bias, w, v = quality.fit(given, np.array([truth[i] for i in order], np.float64))
    for i, (at, x) in features.items():
        pairs = sum(float(v[at[a]] @ v[at[b]]) * x[a] * x[b] for a in range(len(at)) for b in range(a + 1, len(at)))
        assert abs(found[i] - 1 / (1 + np.exp(-(bias + w[at] @ x + pairs)))) < 1e-4
    assert all((found[i] >= 0.5) == bool(y) for i, y in truth.items())


def test_distinct_grams():
    text = np.frombuffer("Ababab".encode(), np.uint8)
    found = toxicity.features(text, np.zeros(1 << toxicity.BITS, np.int32))
    assert len(found) == len(set(found)) == 6  # aba bab abab baba ababa babab


def test_toxicity_by_brute_force(spark):
    """The fit and the scores of a small table, computed anew from the definition."""
    rows = [(i, ("bad wörd " if i % 3 == 0 else "good wort ") + f"text {i}", int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = {r.doc_id: r.tox_score for r in toxicity.toxicity(docs, labels).collect()}
    grams = [{text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)} for _, text, _ in rows]
    mark = np.zeros(1 << toxicity.BITS, np.int32)
    at = [toxicity.features(np.frombuffer(t.encode(), np.uint8), mark) for _, t, _ in rows]
    assert all(len(a) == len(g) for a, g in zip(at, grams, strict=True))
    weights, bias = toxicity.train(docs, labels)
    for (i, _, y), a in zip(rows, at, strict=True):
        assert abs(found[i] - 1 / (1 + np.exp(-(bias + weights[a].sum(dtype=np.float64))))) < 1e-9
        assert (found[i] >= 0.5) == y
    positive = np.array([y for *_, y in rows])
    for gram in ("bad", "wör", "text ", "good"):
        held = np.array([gram in g for g in grams])
        ratio = np.log((held[positive == 1].sum() + 1) / (positive.sum() + 2)) - np.log((held[positive == 0].sum() + 1) / ((1 - positive).sum() + 2))
        place = toxicity.features(np.frombuffer(gram.encode(), np.uint8), mark)[-1]
        assert np.sign(weights[place]) in (0, np.sign(ratio)) or abs(ratio) < 0.2


def test_long_texts_have_the_features_of_their_parts():
    mark = np.zeros(1 << toxicity.BITS, np.int32)
    text = np.frombuffer(("añb cd " * 400_000).encode(), np.uint8)
    assert set(toxicity.features(text, mark)) == set(toxicity.features(text[: 8 * 40], mark))


def test_language_by_brute_force(spark):
    """Dictionaries and sizes computed anew from the definition; sixty languages, copies and a dominant one."""
    import zstandard

    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(40)]
        rows += [(1000 * k + i, " ".join(rng.choice(words, 30)), f"l{k:02}") for i in range(8)]
    rows += [(10**6 + i, rows[0][1], "l00") for i in range(300)] + [(10**7 + i, f"{rows[i % 8][1]} {rows[(i + 1) % 8][1]}", "l00") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = language.sampled(docs, 16)
    assert len(learnt) == 60 and all(len(t) == len(set(t)) <= 16 for t in learnt.values()) and len(learnt["l00"]) == 16 and len(learnt["l05"]) == 8
    found = {r.doc_id: r.lang_pred for r in language.languages(docs, docs, per_language=16).collect()}
    encoders = {}
    for name, texts in learnt.items():
        held = zstandard.ZstdCompressionDict(language.dictionary(texts), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=language.LEVEL)
        encoders[name] = zstandard.ZstdCompressor(dict_data=held, level=language.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
    for doc_id, text, _ in rows[::7]:
        assert found[doc_id] == min(sorted(encoders), key=lambda n: len(encoders[n].compress(language.normal(text))))
    assert np.mean([found[d] == lang for d, _, lang in rows]) > 0.95


def test_repeated_ids_are_learnt_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert sorted(r.doc_id for r in toxicity.labelled_sample(docs, labels, "toxic", 100).collect()) == [1, 2]
