import collections

from octavo.llm import mixing


def water(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        out = {s: cap * sizes[s] if s in capped else rest * w[s] / free for s in names}
        more = {s for s in names if s not in capped and out[s] > cap * sizes[s]}
        if not more:
            return out
        capped |= more


def test_targets_and_amounts(docs):
    rows = mixing.taken(mixing.schedule(docs)).collect()
    sizes = collections.Counter()
    got = collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
        got[r.source] += r.taken
        assert r.taken <= 2 * r.size
    want = water(sizes)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(got[s] - want[s]) <= 1


def test_schedule_is_even(docs):
    mix = mixing.schedule(docs)
    plan = mix.plan.collect()
    total = sum(r.to_word - r.from_word for r in plan)
    slots = sorted({(r.slot, r.k) for r in plan})
    by = collections.Counter(k for _, k in slots)
    half = collections.Counter(k for s, k in slots[: len(slots) // 2])
    for k, n in by.items():
        assert abs(half[k] - n / 2) < 6  # a half of the schedule holds a half of each source
    assert len(slots) == len({s for s, _ in slots}) and total == sum(r.taken for r in mixing.taken(mix).collect())
    words = collections.Counter()
    for r in plan:
        words[r.slot] += r.to_word - r.from_word
    assert max(words.values()) <= mix.block


def test_reruns_agree(docs):
    a, b = (sorted(map(tuple, mixing.schedule(docs.repartition(n)).plan.collect())) for n in (3, 7))
    assert a == b


def test_mixed_documents(docs):
    rows = {r.id: r for r in mixing.taken(mixing.schedule(docs)).collect()}
    counts = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert all(abs(counts[i] - r.taken / r.size) <= 0.5 for i, r in rows.items() if r.size)
    assert mixing.mixed(docs).columns == docs.columns


def test_edges(odd, empty):
    rows = mixing.taken(mixing.schedule(odd)).collect()
    assert len(rows) == 10 and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() > 0
    assert mixing.taken(mixing.schedule(empty)).count() == 0 and mixing.mixed(empty).count() == 0
