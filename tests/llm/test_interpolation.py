import collections
import math
import re
import zlib

import numpy as np
import pytest

from octavo.llm import interpolation as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, order=3, exact=False):
    """Counts, weights by plain EM over every deleted token (ratios rounded as in the operator, or exact), and scores."""
    toks = [(i, zlib.crc32(str(i).encode()) % 7 if i is not None else 0, [*WORD.findall((t or "").translate(LOW)), None]) for i, t in rows]
    counts, deleted = collections.Counter(), collections.Counter()
    for _, part, w in toks:
        for on, c in ((part != 2, counts), (part == 5, deleted)):
            if on:
                seq = ["<s>", "<s>", *w]
                c["<s>",] += 1
                for i in range(2, len(seq)):
                    c.update([(seq[i],), tuple(seq[i - 1 : i + 1]), tuple(seq[i - 2 : i + 1])])
    words = [x for x in counts if len(x) == 1 and x != ("<s>",)]
    left = {x: counts[x] - deleted[x] for x in counts}
    size = lambda c: (sum(c[x] for x in words), sum(c[x] > 0 for x in words))
    level = lambda c: int(math.log2(c)) + 1 if c else 0
    near = lambda r: r if exact else math.expm1(min(lm.CELLS - 1, round(lm.STEPS * math.log1p(r))) / lm.STEPS)
    get = lambda c, k: c.get(k, 0)

    def parts(c, seq, i):
        """Contexts' counts, and the three estimates."""
        n, v = size_of[id(c)]
        one, two = get(c, (seq[i - 1],)), get(c, (seq[i - 2], seq[i - 1])) if i > 2 else get(c, ("<s>",))
        return one, two, get(c, (seq[i],)) / n, get(c, tuple(seq[i - 1 : i + 1])) / one if one else 0.0, get(c, tuple(seq[i - 2 : i + 1])) / two if two else 0.0, v

    size_of = {id(counts): size(counts), id(left): size(left)}

    def p2(one, r1, r2, v):
        q = weights[level(one)]
        return q[0] * r2 + q[1] * r1 + q[2] / (v + 1) if one else (q[1] * r1 + q[2] / (v + 1)) / (q[1] + q[2])

    events, longer = collections.defaultdict(list), collections.defaultdict(list)
    for _, part, w in toks:
        if part == 5:
            seq = ["<s>", "<s>", *w]
            for i in range(2, len(seq)):
                one, _, r1, r2, _, v = parts(left, seq, i)
                events[level(one)].append((near(r2 * (v + 1)), near(r1 * (v + 1)), 1.0))
    weights = {}
    for b in range(lm.BUCKETS):
        if b in events:
            r, q = np.array(events[b]).T, np.full(3, 1 / 3)
            for _ in range(60):
                s = q[:, None] * r
                q = (s / s.sum(0)).sum(1) + 1
                q /= q.sum()
            weights[b] = q
        else:
            weights[b] = weights[b - 1] if b > 1 else np.array([1e-9, 0.5, 0.5]) if b == 0 else np.full(3, 1 / 3)
    for _, part, w in toks:
        if part == 5:
            seq = ["<s>", "<s>", *w]
            for i in range(2, len(seq)):
                one, two, r1, r2, r3, v = parts(left, seq, i)
                longer[level(two)].append(near(r3 / p2(one, r1, r2, v)))
    lam = {0: 0.0}
    for b in range(1, lm.BUCKETS):
        if b in longer:
            x, q = np.array(longer[b]), 0.5
            for _ in range(60):
                q = ((q * x / (q * x + 1 - q)).sum() + 1) / (len(x) + 2)
            lam[b] = q
        else:
            lam[b] = lam[b - 1] if b > 1 else 0.5
    n, v = size_of[id(counts)]
    out = []
    for i, part, w in toks:
        seq, score, base = ["<s>", "<s>", *w], 0.0, 0.0
        for k in range(2, len(seq)):
            one, two, r1, r2, r3, _ = parts(counts, seq, k)
            p = p2(one, r1, r2, v)
            if order > 2 and two:
                p = lam[level(two)] * r3 + (1 - lam[level(two)]) * p
            score += math.log10(p)
            base += math.log10((get(counts, (seq[k],)) + 1) / (n + v + 1))
        out.append((i, part == 2, len(w), sum(get(counts, (x,)) > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize(("order", "fan"), [(3, 128), (2, 128), (3, 4)])
def test_brute_force(docs, monkeypatch, order, fan):
    monkeypatch.setattr(lm, "SHARD", 20_000)  # many shards and ranges, reached in one hop or in several
    monkeypatch.setattr(lm, "BUCKET", 50_000)
    monkeypatch.setattr(lm, "FAN", fan)
    got = {r.doc_id: tuple(r) for r in lm.score(docs, order=order).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for want in brute(rows, order):
        have = got[want[0]]
        assert have[:5] == want[:5]
        assert math.isclose(have[5], want[5], rel_tol=1e-9) and math.isclose(have[6], want[6], rel_tol=1e-7)
    if fan == 128:  # EM's ratios are rounded: that hardly matters
        assert all(math.isclose(got[w[0]][6], w[6], rel_tol=0.005) for w in brute(rows, order, exact=True))


def test_blocks_grow_with_the_corpus():
    """At most fan blocks for each task of every hop, and tasks in proportion to the corpus; one hop alone would need the square."""
    shards_ = [1_000, 10_000, 100_000, 1_000_000]
    found = []
    for n in shards_:
        net = lm.Network(n, n, 128)
        nodes, blocks = n, 0
        for hop in range(1, net.hops + 1):
            blocks += nodes * net.fan
            nodes = net.groups[hop - 1] * net.fan**hop
        assert net.fan <= 128 and net.groups[-1] == 1 and net.fan**net.hops >= n
        found.append(blocks / n)
    assert max(found) <= 4 * 128 and shards_[-1] > 1000 * max(found)


def test_better_than_the_base(docs):
    held = [r for r in lm.score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    """Over all known words and one unknown, after each context."""
    texts = ["a b c", "a b", "b c a", "c a b a", "a c"] * 4
    words = ["a", "b", "c", "zzz"]
    rows = list(enumerate(texts)) + [(1000 + i, w) for i, w in enumerate(words)] + [(2000, "")]
    ids = [i for i in range(10**5, 10**5 + 200) if zlib.crc32(str(i).encode()) % 7 == 2][: len(words) + 1]
    rows = list(enumerate(texts)) + list(zip(ids, [*words, ""], strict=True))
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # p(w | start) p(end | w): the end's part is taken out by scoring two texts that differ in it
    assert all(s < 0 for s in got.values())
    assert 10 ** got[ids[-1]] + sum(10 ** got[i] for i in ids[:-1]) < 1


def test_edges(odd, empty):
    rows = lm.score(odd).collect()
    assert len(rows) == 10 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (None, 1, 2)} == {1}
    assert lm.score(empty).count() == 0
