import zlib

import numpy as np
import pyarrow as pa

from octavo.llm import langid
from octavo.llm.blocks import LETTERS, column_bytes, span_hash, word_spans


def brute_marginals(scores, transitions, start):
    """Sums over all label sequences of a short chain."""
    import itertools

    n, k = scores.shape
    post, total = np.zeros((n, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(start[path[0]] + sum(scores[i, p] for i, p in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for i, p in enumerate(path):
            post[i, p] += w
    return post / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 2, 5]
    begin = np.cumsum([0, *sizes[:-1]])
    scores, t, s = rng.normal(size=(12, 3)).astype(np.float32), rng.normal(size=(3, 3)), rng.normal(size=3)
    post, expected, first = langid.marginals(scores, begin, np.array(sizes), t, s, pairs=True)
    for b, n in zip(begin, sizes, strict=True):
        assert np.allclose(post[b : b + n], brute_marginals(scores[b : b + n], t, s), atol=1e-5)
    assert np.isclose(expected.sum(), sum(n - 1 for n in sizes)) and np.isclose(first.sum(), 4)


def plain_scores(model, text):
    """Mean posterior of each language over a text's words: forward and backward sums in logarithms, line by line, word by word."""
    raw, offs = column_bytes(pa.array([text], pa.string()))
    m, starts, ends, doc = word_spans(raw, offs, LETTERS)
    begin, size = langid.lines(raw, starts, doc)
    total, words = np.zeros(len(model.languages)), 0
    for b, n in zip(begin.tolist(), size.tolist(), strict=True):
        e = np.concatenate([model.emissions(m, starts[i : i + 1], ends[i : i + 1], span_hash(m, starts[i : i + 1], ends[i : i + 1])) for i in range(b, b + n)]).astype(float)
        ahead, back = [model.start + e[0]], [np.zeros(len(e[0]))]
        for i in range(1, n):
            ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + model.transitions, axis=0) + e[i])
        for i in range(n - 1, 0, -1):
            back.insert(0, np.logaddexp.reduce(model.transitions + e[i] + back[0], axis=1))
        both = np.array(ahead) + np.array(back)
        total += np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None]).sum(0)
        words += n
    return total / words if words else None


def test_query_against_plain_sums(spark, sf, docs):
    """The whole query: every text's label and score."""
    from octavo.llm import queries

    model = langid.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op1_language_crf(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        want = plain_scores(model, texts[r.doc_id]) if any(map(str.isalpha, texts[r.doc_id] or "")) else None
        if want is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert abs(r.score - want.max()) < 1e-4 and want[model.languages.index(r.lang_pred)] > want.max() - 1e-4


def test_held_out_accuracy(docs):
    model = langid.fit(docs)
    rows = langid.predict(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switching(spark, docs):
    rows = docs.select("text", "lang").collect()
    en, de = (next(r.text for r in rows if r.lang == x and len(r.text) > 400) for x in ("en", "de"))
    mixed = " ".join(en.split()[:40]) + " " + " ".join(de.split()[:40])
    found = langid.label_words(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), langid.fit(docs)).first().runs
    words = {x: sum(r.words for r in found if r.lang == x) for x in ("en", "de")}
    assert words["en"] > 30 and words["de"] > 30
    data = mixed.encode()
    assert data[found[0].start : found[0].end].decode() in mixed


def test_edges(docs, odd, empty):
    model = langid.fit(docs)
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()]
    assert len(got) == 10
    by = dict(got)
    assert by[None] == by[1] == by[2] == by[7] == "und" and by[3] != "und"
    assert langid.predict(empty, model).count() == 0
    assert langid.accepted(odd, model).columns == odd.columns
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_letters():
    assert langid.has_letter(pa.array(["a", "1 2", "é", "！", None, ""])).tolist() == [True, False, True, False, False, False]
