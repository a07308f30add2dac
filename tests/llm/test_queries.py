"""Registered queries against SQL, where it can say them, and the whole pipeline's contract."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from octavo.llm import langid, queries
from tests.llm.test_mixing import water
from tests.llm.test_stores import ids_of as plain_ids
from tests.oracle import connect, difference


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, name):
    assert difference(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) == ""


WORD, SPACED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute_duplicates(rows):
    """One document of each component of similar 5-word sets: the smallest id."""
    sets = {}
    for r in rows:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def brute_clean(rows, items):
    windows = set()
    for t in items:
        w = words(t)
        k = min(10, len(w))
        windows |= {tuple(w[a : a + k]) for a in range(len(w) - k + 1) if k}
    sizes = {len(x) for x in windows}
    return {r.doc_id for r in rows if not any(tuple(w[a : a + k]) in windows for w in [words(r.text)] for k in sizes for a in range(len(w) - k + 1))}


def brute_mix(rows):
    """How often each document is in the mix: streams by md5 of the id, read twice at most, up to the targets."""
    size = {r.doc_id: len(SPACED.findall(r.text or "")) for r in rows}
    total = collections.Counter()
    for r in rows:
        total[r.source] += size[r.doc_id]
    target = water(total)
    out = collections.Counter()
    for source in total:
        own = sorted((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id) for r in rows if r.source == source)
        for reading in range(2):
            at = reading * total[source]
            for _, i in own:
                if size[i] and 2 * max(0, min(at + size[i], int(target[source] + 0.5)) - at) >= size[i]:
                    out[i] += 1
                at += size[i]
    return out


def test_pipeline_against_brute_force(spark, sf, docs, tokenizer):
    """Every stage on what the one before kept."""
    stages = [f for _, f in corpus_pipeline.STAGES]
    ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    fixed = lambda df: spark.createDataFrame(df.collect(), docs.schema)
    spoken = fixed(stages[0](spark, docs, sf))
    model = langid.fit(docs)
    known = {r.doc_id for r in langid.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= 0.4}
    assert set(ids(spoken)) == known and len(known) >= 0.98 * docs.count()
    single = fixed(stages[1](spark, spoken, sf))
    assert set(ids(single)) == brute_duplicates(spoken.collect())
    clean = fixed(stages[2](spark, single, sf))
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(ids(clean)) == brute_clean(single.collect(), items)
    mixed = fixed(stages[3](spark, clean, sf))
    assert ids(mixed) == brute_mix(clean.collect())
    assert all(df.columns == docs.columns for df in (spoken, single, clean, mixed))
    last = sorted(map(tuple, stages[4](spark, mixed, sf).collect()), key=lambda r: r[1])
    start = 0
    for r, got in zip(sorted(mixed.collect(), key=lambda r: r.doc_id), last, strict=True):
        want = plain_ids(tokenizer, r.text)
        assert got == (r.doc_id, start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=lambda r: r[1]) == last


CLASHING = ("last", "_drop", "_twice", "_source", "root", "bands", "c", "_c", "key", "id", "limit", "source_of", "this_id", "this_class", "other_id", "lang_pred", "n_hit")


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_pipeline_on_odd_tables(spark, which, odd, empty, tokenizer, tmp_path):
    """Nulls, repeated rows, empty and very long texts, columns named as the stages' own ones; and no rows at all."""
    import functools

    from pyspark.sql import functions as F

    docs = functools.reduce(lambda df, c: df.withColumn(c, F.lit(7)), CLASHING, odd if which == "odd" else empty)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "quite another passage"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = spark.createDataFrame(stage(spark, table, str(tmp_path)).collect(), docs.schema)
        assert table.columns == docs.columns
        left.append(sorted(r.doc_id for r in table.collect()))
    # null, empty and unlettered texts are undetermined; one of the three equal texts stays
    last = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    if which == "empty":
        assert left == [[]] * 4 and last == []
    else:
        assert set(left[0]) <= {3, 4, 5, 6, 8} and left[0].count(3) == 2 and left[1] == sorted(set(left[0]) - {4}) and left[2] == left[1]
        assert sorted(r[0] for r in last) == left[3] and set(left[3]) <= set(left[2])
