"""Near-duplicate groups against brute force."""

import re

import duckdb
import pytest

from evidentia.llm import queries
from evidentia.llm.graph import components
from evidentia.llm.near_dedup import near_duplicates

KIND = "doc_id long, text string, n int, bands string, component_id string"


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    home = {i: i for i in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                home[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(base, at, n):
    words = base.split()
    for j in range(n):
        words[(at + 3 * j) % len(words)] = f"x{at}_{j}"
    return " ".join(words)


def family():
    """A base, light edits that link to it, and heavy edits that link to it or to one another only."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base)] + [(10 + i, edited(base, i, 1)) for i in range(12)] + [(40 + i, edited(base, i, 4)) for i in range(12)]
    heavy = edited(base, 5, 6)
    return rows + [(80, heavy), (81, heavy + " tail"), (82, " ".join(heavy.split()[:-2])), (90, " ".join(base.split()[:50])), (91, " ".join(base.split()[:45]))]


@pytest.mark.parametrize("k", [2, 5])
def test_brute_force(spark, k):
    rows = family() + [(200, None), (201, ""), (202, " \t"), (203, "One"), (204, "oNE"), (205, "two words"), (206, "two words"), (207, "É é"), (208, "É É"), (300, "zz " * 3000), (301, "zz " * 2999)]
    frame = spark.createDataFrame([(i, t, 7, "c", "c") for i, t in rows], KIND)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, k).collect()}
    assert found == brute(rows, k)


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, "a b c", 1, "", ""), (None, None, 1, "", ""), (5, "a b c", 1, "", ""), (5, "a b c", 1, "", "")], KIND)
    found = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(frame, 2).collect())
    assert found == [(-1, -1, True), (-1, -1, True), (5, 5, True), (5, 5, True)]
    assert near_duplicates(frame.limit(0), 2).count() == 0


def brute_rows(rows, k):
    """As `brute`, but each row is a document of its own: (id, size, component's least id)."""
    sets = [shingles(t, k) for _, t in rows]
    home = list(range(len(rows)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                home[root(j)] = root(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


def test_ids_with_several_texts(spark):
    """Each row's text is compared with all others; no link is lost where an id has several."""
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    rows = [(2, base[0]), (2, base[1]), (10, base[0] + " x"), (1, base[1] + " y"), (-7, base[2]), (2, base[2] + " z"), (30, base[3]), (30, base[3] + " w"), (30, base[4]), (4, base[4] + " v"), (4, base[5]), (4, base[5])]
    rows += [(50 + i % 5, edited(base[i % 6], i, 2)) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(frame, 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_rows(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_blocks_bounded_by_bytes(spark, monkeypatch):
    """With blocks of a few hundred bytes a group is settled in many of them, and gives the same components."""
    import evidentia.llm.near_dedup as nd

    base = " ".join(f"a{i}" for i in range(40))
    rows = [(i, edited(base, i, 1 + i % 7)) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(tuple(r) for r in near_duplicates(frame, 2).collect())
    monkeypatch.setattr(nd, "BLOCK_BYTES", 400)
    assert sorted(tuple(r) for r in near_duplicates(frame, 2).collect()) == plain
    assert {r[0]: (r[1], r[2]) for r in plain} == brute(rows, 2)


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op6_near_dedup"]).fetchall())
    assert sorted(tuple(r) for r in queries.op6_near_dedup(spark, sf_dir).collect()) == want


def test_components(spark):
    edges = [(1, 2), (2, 1), (3, 2), (9, 8), (4, 4), (20, 30), (30, 40), (40, 50), (50, 60), (60, 10), (None, 3)]
    found = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {2: 1, 3: 1, 9: 8, 20: 10, 30: 10, 40: 10, 50: 10, 60: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
