import random

import numpy as np
import pyarrow as pa
import pytest

from octavo.llm import jaccard
from octavo.llm.components import components


def brute(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = dict.fromkeys(texts, 0)
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in texts}


def near_copies(n: int, words: int, edits: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def mixed_texts():
    rng = random.Random(3)
    texts = [" ".join(f"r{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    for g in range(6):
        texts += near_copies(6, 120, 1 + g, g)
    texts += [texts[0]] * 5 + ["a b c", "a b c", "a b d", "", None]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(40)) for _ in range(30)]
    return dict(enumerate(texts))


def test_brute_force(spark, mixed_texts):
    df = spark.createDataFrame(list(mixed_texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(df).collect()}
    assert got == brute(mixed_texts)


def test_large_groups_in_blocks(spark, monkeypatch):
    """Buckets over SMALL and clusters over BLOCK give the same links."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    texts = dict(enumerate(near_copies(70, 200, 4, 9) + near_copies(20, 260, 2, 10)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(df).collect()}
    assert got == brute(texts)


def test_banding():
    bands = jaccard.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**jaccard.ROWS) ** bands >= 0.9995 > 1 - (1 - 0.8**jaccard.ROWS) ** (bands - 1)


def test_signatures_estimate_similarity():
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(40, 440))
    grams, offs = jaccard.gram_sets(pa.array([a, b, ""]), 5)
    sig = jaccard.signatures(grams, offs, 400)
    s = [set(grams[offs[i] : offs[i + 1]].tolist()) for i in range(2)]
    assert abs((sig[0] == sig[1]).mean() - len(s[0] & s[1]) / len(s[0] | s[1])) < 0.08
    assert (sig[2] == 0xFFFFFFFF).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, 201), (300, 300), (None, 5)]
    got = {r.id: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(odd, empty):
    rows = jaccard.join(odd).collect()
    assert len(rows) == 10
    by = {r.doc_id: (r.class_id, r.n_links) for r in rows}
    assert by[3] == by[4] == (3, 2) and by[1] == (1, 0) and by[None] == (None, 0)
    assert jaccard.join(empty).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 5, 6, 7, 8] and ids.count(None) == 1
    assert jaccard.one_of_each(empty).count() == 0


def test_rows_not_ids_are_removed(spark):
    """Null ids and ids with several texts lose only what another document stands for."""
    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcde")
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (None, None), (None, ""), (2, d), (2, a), (3, e), (3, e), (3, None), (4, b + " x"), (4, b + " x")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a), (None, c), (None, None), (None, ""), (2, d), (3, e), (3, None), (4, b + " x")], key=str)
    alone = [(None, b), (None, b), (None, c), (None, d), (None, d)]
    kept = jaccard.one_of_each(spark.createDataFrame(alone, "doc_id long, text string"))
    assert sorted(r.text for r in kept.collect()) == [b, c, d]


def test_matrix_of_links():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4], [9], [1, 2, 3, 4, 5, 6])]
    m = jaccard.matched(sets, np.arange(4), np.arange(4), 0.8)
    assert m.tolist() == [[False, True, False, True], [True, False, False, False], [False] * 4, [True, False, False, False]]
