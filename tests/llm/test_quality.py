import zlib

import numpy as np
import pyarrow as pa

from octavo.llm import quality


def test_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    m = quality.Machine(0.3, rng.normal(size=quality.DIM).astype(np.float32), rng.normal(size=(quality.DIM, quality.RANK)).astype(np.float32))
    i, x = np.array([1, 5, 9, 70000 % quality.DIM]), np.array([0.5, 1.0, 2.0, 0.1], np.float32)
    pairs = sum((m.factors[i[a]] @ m.factors[i[b]]) * x[a] * x[b] for a in range(4) for b in range(a + 1, 4))
    got = m.raw(i, x, np.array([0, 4]))[0][0]
    assert np.isclose(got, 0.3 + (m.linear[i] * x).sum() + pairs, atol=1e-3)


def test_query_against_all_pairs(spark, sf, docs):
    """The whole query: each text's score as a plain sum over all pairs of its features."""
    from octavo.llm import queries

    machine = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), size="n_chars")
    rows = {r.doc_id: r for r in docs.collect()}
    got = queries.op3_quality_fm(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        own = rows[r.doc_id]
        i, x, _ = quality.features(pa.array([own.text], pa.string()), np.array([own.n_chars or 0]))
        v = machine.factors[i].astype(float) * x[:, None]
        gram = v @ v.T
        logit = machine.bias + float((machine.linear[i].astype(float) * x).sum()) + float(np.triu(gram, 1).sum())
        want = 1 / (1 + np.exp(-logit))
        assert abs(r.score - want) < 1e-3 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_quality(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    machine = quality.fit(docs, labels, size="n_chars")
    rows = {r.doc_id: r for r in quality.score(docs, machine, size="n_chars").collect()}
    held = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    if good and bad:
        assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all((r.score >= 0.3) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows.values())


def test_inputs_leave_the_label_columns_out(docs, spark, sf):
    """Other languages, sources and ids change no score."""
    from pyspark.sql import functions as F

    machine = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    a = {r.doc_id: r.score for r in quality.score(docs, machine).collect()}
    b = {-r.doc_id: r.score for r in quality.score(docs.select((-F.col("doc_id")).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("q").alias("source")), machine).collect()}
    assert a == b


def test_edges(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (8, 1, None), (8, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    machine = quality.fit(odd, labels)
    assert quality.score(odd, machine).count() == 10
    assert quality.score(empty, machine).count() == 0
    none = quality.fit(empty, labels)
    assert {round(r.score, 3) for r in quality.score(odd, none).collect()} <= {round(x / 1000, 3) for x in range(1001)}
    assert quality.features(pa.array([], pa.string()))[2].tolist() == [0]
