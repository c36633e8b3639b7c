"""The corpus pipeline, stage by stage on what the stage before kept."""

import corpus_pipeline as cp
from evidentia.llm.secret_scan import base_spans

from test_decontaminate import brute as leaks
from test_near_dedup import brute as groups


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == cp.COLUMNS
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(kept[name])
    first, second, third, fourth = (kept[name] for name, _ in cp.STAGES[:-1])
    want = {i for i, (_, home) in groups([(r.doc_id, r.text) for r in first.values()], 5).items() if i == home}
    assert set(second) == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:12]
    found = {d for d, _ in leaks([(r.doc_id, r.text) for r in list(second.values())[:40]], items)}
    assert not found & set(third)
    assert {d for d, r in second.items() if any(p in r.text for _, p in items)} & set(third) == set()
    assert set(fourth) == set(third)
    for d, r in fourth.items():
        assert not base_spans(r.text) or "[SECRET]" in r.text
        assert (r.text == third[d].text) == (not base_spans(third[d].text)) or "[SECRET]" in r.text
    last = cp.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(last.doc_id) == set(fourth)
    pieces = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    every = cp.run(spark, sf_dir).toPandas()
    assert sorted(map(tuple, every[pieces].to_numpy())) == sorted(map(tuple, last[pieces].to_numpy()))
    for _, part in every.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() <= 4096


def test_rejected_documents_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in cp.drop_toxic(spark, docs, sf_dir).collect()}
    clean = [d for d, y in labels.items() if y == 0]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_null_and_repeated_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "a b", "en", "s", 3), (None, "a b", "en", "s", 3), (10**9, "only this text here now", "en", "s", 3), (10**9, "only this text here now", "en", "s", 3)], docs.schema)
    kept = cp.near_dedup(spark, odd, sf_dir).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 10**9]


def test_ids_with_several_texts(spark, sf_dir):
    """An id's least text stands for it before copies are looked for: none is lost with another text of its id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, c, "en", "s", 9), (5, c, "en", "s", 9), (5, b, "en", "s", 9), (7, d, None, None, None), (8, c + " more", "en", "s", 9), (9, b, "en", "s", 9), (None, c, "en", "s", 9)]
    kept = cp.near_dedup(spark, spark.createDataFrame(rows, docs.schema), sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, c), (1, c), (5, b), (7, d)]
