"""Every registered query against its oracle; those without one against brute force elsewhere."""

import pytest

from evidentia.plans import ORACLES, QUERIES

from oracle import connection, rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, sf_dir, name):
    mine, theirs = rows(QUERIES[name](spark, sf_dir).toPandas()), rows(con.sql(ORACLES[name]).df())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]


def test_html_text(spark):
    from evidentia.sources.html import html_text

    rows = [("<p>a<script>x('</p>')</script>b<br/>c&amp;d</p>", "ab\nc&d"), (None, None), ("", ""), ("<DIV title='a>b'>x</DIV><!-- <p> -->y", "x y".replace(" ", "")), ("<style>p{}", ""), ("a &lt;b&gt; &eacute; 1 < 2", "a <b> é 1 < 2"), ("<pre>k</pre><link rel=x>l", "kl"), ("<li>1<li>2", "1\n2")]
    found = html_text(spark.createDataFrame(rows, "h string, want string"), "h").collect()
    assert [(r.h, r.plain) for r in found] == rows


def sweep(rows, cap, budget):
    """Batches of one consumer's (decision, group, seq, chars), by the rules as they are told."""
    groups = {}
    for decision, group, seq, chars in sorted(rows, key=lambda r: r[2]):
        groups.setdefault((decision, group), []).append((seq, chars))
    parts = []
    for (decision, _), events in groups.items():
        part = []
        for seq, chars in events:
            if part and sum(c for _, c in part) + chars > budget:
                parts.append((decision, part))
                part = []
            part = [*part, (seq, chars)]
        parts.append((decision, part))
    out, batch = {}, []
    number = -1
    for decision, part in parts:
        size = sum(c for _, c in part)
        if not batch or decision != batch[0][0] or len(batch) + 1 > cap or sum(c for _, p in batch for _, c in p) + size > budget:
            number, batch = number + 1, []
        batch = [*batch, (decision, part)]
        out |= {seq: number for seq, _ in part}
    return out


def test_sweep_brute_force(spark, sf_dir):
    from evidentia.operators import awareness

    found = QUERIES["str_04_sweep"](spark, sf_dir).toPandas()
    assert len(found) and found.batch.max() > 3
    for _, group in found.groupby("user_id"):
        rows = list(zip(group.decision, group.grp, group.event_id, group.chars, strict=True))
        assert dict(zip(group.event_id, group.batch, strict=True)) == sweep(rows, awareness.PACKET_GROUPS, awareness.PACKET_CHARS)
    odd = [("c", "a", "g", 1, 9000), ("c", "a", "g", 2, 10), ("c", "b", "h", 3, 10), ("c", "a", "i", 4, 10)]
    frame = spark.createDataFrame(odd, "c string, d string, g string, n long, size long")
    assert {r.n: r.batch for r in awareness.swept(frame, "c", ["d"], "g", "n", "size", 8, 4000).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert awareness.swept(frame.limit(0), "c", ["d"], "g", "n", "size", 8, 4000).count() == 0


def test_every_record_is_walked_from(spark, tmp_path):
    import random

    from evidentia.operators import graph

    rng = random.Random(7)
    links = [(record, rng.randrange(30)) for record in range(60) for _ in range(rng.randrange(12))]  # with repeats
    links += [(record, 99) for record in range(0, 60, 2)] + [(60, entity) for entity in range(30)] + [(61, 500), (61, None), (None, 99)]
    links += [(62, entity) for entity in (None, 1, 2, 3, 4, 5, 98)] + [(63, 98)]  # no entity takes no place among the first six
    spark.createDataFrame(links, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(record, "FOP"[record % 3]) for record in range(64)], "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    real = {link for link in links if None not in link}
    first = lambda record: sorted(e for r, e in real if r == record)[:6]
    newest = lambda entity: sorted((r for r, e in real if e == entity), reverse=True)[:16]
    want = sorted({(r, met) for r in range(64) for e in first(r) for met in newest(e) if met != r})
    assert {r % 3 for r, _ in want} == {0, 1, 2} and (62, 63) in want
    assert sorted(map(tuple, QUERIES["win_03_degree_caps"](spark, str(tmp_path)).select("record", "met").collect())) == want
    some = graph.expanded(spark.createDataFrame(links, "record long, entity long"), spark.createDataFrame([(60,), (8,), (8,), (None,)], "record long"))
    assert sorted(map(tuple, some.collect())) == [pair for pair in want if pair[0] in (8, 60)]


def test_large_groups_of_duplicates_are_one_list(spark, tmp_path):
    """A group over a thousand, an id of several texts, repeated ids alone, and texts and ids that are null."""
    docs = [(i, "same  text") for i in range(3000)] + [(9000, " same text\n"), (1, "other"), (9001, "other"), (9002, "x"), (9002, "x"), (9003, "y")]
    docs += [(9004, None), (9005, None), (None, "z"), (None, "z"), (None, "same text"), (9006, "w"), (None, "w"), (9007, "v"), (9007, "u"), (0, "t"), (9008, "t"), (9009, "\x0b"), (9010, "")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "x"))
    next((tmp_path / "x").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    want = {first: others for first, others in connection(tmp_path).sql(ORACLES["win_07_duplicate_ids"]).fetchall()}
    found = QUERIES["win_07_duplicate_ids"](spark, str(tmp_path)).collect()
    assert len(found) == len(want) and {r["first"]: r.duplicates for r in found} == want
    assert len(want[0]) == 3001 and want[9002] is None and None in want and want[9004] == [9005]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
