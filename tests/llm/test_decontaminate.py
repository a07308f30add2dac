import hashlib
import re

import numpy as np
import pytest

from octavo.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = WORD.findall((t or "").translate(LOW)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                own = windows.get(tuple(w[a : a + k]))
                if own:
                    found |= own
                    hit |= set(range(a, a + k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {"None"})).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def report(df, items, **options):
    return sorted(map(tuple, dc.scan(df, items, **options).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_brute_force(spark, sf, docs, block):
    """One block of items, and many."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    more = items.select("item_id", "text").unionByName(spark.createDataFrame([(900, "The"), (901, "of the"), (902, "one Two THREE four"), (903, "")], "item_id long, text string"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in more.collect()])
    assert report(docs, more, block_words=block) == want
    assert any(x[5] for x in want)


def test_longest_matches(spark):
    item = " ".join(f"b{i}" for i in range(40))
    text = "x y " + " ".join(f"b{i}" for i in range(5, 30)) + " z " + " ".join(f"b{i}" for i in range(12))
    rows = dc.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in rows.matches] == [("7", 0, 28, 12), ("7", 5, 2, 25)]


def test_suffix_array():
    rng = np.random.default_rng(8)
    w = np.append(rng.integers(1, 4, 200), np.zeros(20)).astype(np.uint64)
    sa = dc.suffix_array(w, np.arange(200), 20)
    keys = [tuple(w[p : p + 20].tolist()) for p in sa]
    assert keys == sorted(keys) and sorted(sa) == list(range(200))


def test_edges(spark, odd, empty):
    items = spark.createDataFrame([(0, "one two three"), (1, None), (None, "five six seven"), (2, "!!"), (0, "one two three")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert report(odd, items) == brute(rows, [(0, "one two three"), (None, "five six seven")])
    assert report(odd, items, unnamed=False) == brute(rows, [(0, "one two three")])
    assert dc.scan(empty, items).count() == 0
    assert not any(r.contaminated for r in dc.scan(odd, items.limit(0)).collect())
    kept = dc.remove_affected(odd, items)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "6", "7", "8", "None"]
    assert "p_n_words" in dc.scan(odd, items, prefix="p_").columns and "n_words" in dc.scan(odd, items, prefix="p_").columns


def test_items_without_id(spark, tmp_path):
    """What the query's SQL says of items with a null id; the pipeline removes the documents that quote them."""
    import duckdb

    import corpus_pipeline
    from octavo.llm import queries

    long = " ".join(f"b{i}" for i in range(14))
    docs = spark.createDataFrame([(1, "x one two three y"), (2, f"z {long} z"), (3, "one two three four five"), (4, "clean"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(0, "one two three"), (None, "four five"), (None, long), (None, None)], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = queries.QUERIES["op9_suffix_decontaminate"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(queries.ORACLES["op9_suffix_decontaminate"]).fetchall())
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in got.collect()} == {1: (3, 1, True), 2: (14, 1, True), 3: (5, 2, True), 4: (0, 0, False), 5: (0, 0, False)}
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == [4, 5]
    assert [m.item_id for m in dc.scan(docs, items, unnamed=True).where("doc_id = 3").first().matches] == [None, "0"]
