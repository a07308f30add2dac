"""Language-model scores by deleted interpolation of word triples, pairs, words and the uniform distribution.

p2(w | v) = l2(b) c(vw) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of the context's count c(v)
(its binary logarithm), and p(w | uv) = l3(b) c(uvw) / c(uv) + (1 - l3(b)) p2(w | v) with the bucket of c(uv). The
weights of each bucket are learned by expectation-maximisation on a deleted part of the training documents, whose
counts are taken out of the estimates for it: first those of p2, then l3.

Counting and looking up are exchanges of blocks, not of rows. Texts are dealt into shards; a shard's distinct n-grams
(hashes, sorted) go in blocks to ranges of the hash space, where the counts of all shards are added up and sent back
in the same order. So a frequent n-gram is one entry for each shard, and nothing of the corpus is collected or
broadcast but the weights and the totals. More than ``FAN`` ranges are reached in several hops: a hop merges the blocks
of a group of tasks and cuts the result into at most ``FAN`` ranges for the next one, and the totals come back the same
way. So the number of blocks grows with the corpus (and the logarithm of its size), not with its square.

Shards are written once and every pass reads them, so lost executors change nothing.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.llm.blocks import NONSPACE, U8, column_bytes, mix, run_starts, shards, span_hash, word_spans
from octavo.llm.shared import keep

#: Training documents are those whose crc32(id) mod FOLDS is not HELD; of these, DELETED is the part for EM.
FOLDS, HELD, DELETED = 7, 2, 5
SHARD = 6 << 20
#: Bytes of text whose n-grams are counted in one range, and ranges that one task sends blocks to.
BUCKET, FAN = 8 << 20, 128
#: Pairs and triples are known by hashes with so many bits more than their number has: one in a million collides.
SPARE = 20
_END, _START = U8(0x243F6A8885A308D3), U8(0x13198A2E03707345)
_A, _B = U8(0x9E3779B97F4A7C15), U8(0xC2B2AE3D27D4EB4F)
#: Ratios of estimates are kept to 1 / STEPS in the natural logarithm for EM: at most CELLS each.
STEPS, CELLS, BUCKETS = 16, 512, 64
ORDER = 3


def deflate(values: np.ndarray, z: zstandard.ZstdCompressor) -> bytes:
    """Integers by byte planes, compressed."""
    return z.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def inflate(data: bytes, kind: str, n: int, z: zstandard.ZstdDecompressor) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(z.decompress(data, max_output_size=max(1, n * size)), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def key_bits(size: int) -> int:
    """Bits of the hashes of pairs and triples for a corpus of so many bytes."""
    return min(64, SPARE + max(1, int(size) // 2).bit_length())


class Tokens:
    """A shard's tokens: each text's words and its end, and the n-grams' keys (words: 64 bits, longer ones: ``bits``)."""

    def __init__(self, column: pa.Array, bits: int = 64, order: int = ORDER):
        raw, offs = column_bytes(column)
        m, starts, ends, doc = word_spans(raw, offs, NONSPACE)
        n = len(offs) - 1
        count = np.bincount(doc, minlength=n)
        self.doc = np.repeat(np.arange(n), count + 1)
        word = np.full(len(self.doc), _END)
        word[np.arange(len(starts)) + doc] = span_hash(m, starts, ends)
        self.n = count + 1
        drop = U8(64 - bits)
        pair = mix(word * _A + mix(previous(word, self.n, _START) * _B))
        self.grams = [word, pair >> drop]
        if order > 2:
            self.grams.append(mix(word * _B + mix(previous(pair, self.n, _START) * _A)) >> drop)


def previous(values: np.ndarray, sizes: np.ndarray, start) -> np.ndarray:
    """The value at the token before, or ``start`` at the first of a text."""
    out = np.roll(values, 1)
    out[np.cumsum(sizes) - sizes] = start
    return out


def parts_of(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % FOLDS if i is not None else 0 for i in ids.to_pylist()], np.int64)


def dealt(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """Shards: a number (odd for those of the deleted part), and the ids and texts of some megabytes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)

        def packed(rows: pa.RecordBatch | pa.Table, deleted: bool) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write(rows)
            number = uuid.uuid4().int >> 66 << 1 | deleted
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([z.compress(sink.getvalue().to_pybytes())], pa.binary())], ["shard", "a"])

        held: list[pa.RecordBatch] = []  # rows of the deleted part, until there are as many as in other shards
        for shard in shards(batches, text, SHARD):
            own = parts_of(shard.column(0)) == DELETED
            if not own.all():
                yield packed(shard.filter(pa.array(~own)), False)
            if own.any():
                held.append(shard.filter(pa.array(own)))
                if sum(x.nbytes for x in held) > SHARD:
                    yield packed(pa.Table.from_batches(held), True)
                    held.clear()
        if held:
            yield packed(pa.Table.from_batches(held), True)

    return docs.select(id_col, text).mapInArrow(run, "shard bigint, a binary")


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().combine_chunks().to_batches()[0]


class Network:
    """The hops between shards and ranges: ``fan`` ranges of each, ``fan_in`` tasks to a group.

    After hop l there are fan ** l ranges and groups / fan_in ** (l - 1) groups; after the last, one group.
    """

    def __init__(self, n_shards: int, ranges: int, fan: int = FAN):
        self.hops = max(1, math.ceil(math.log(max(1, ranges)) / math.log(fan) - 1e-9))
        self.fan = max(1, math.ceil(ranges ** (1 / self.hops) - 1e-9))
        fan_in = max(1, math.ceil(max(1, n_shards) ** (1 / self.hops) - 1e-9))
        self.groups = [max(1, math.ceil(n_shards / fan_in**hop)) for hop in range(1, self.hops)] + [1]

    def bounds(self, hop: int, parent: int, bits: int) -> list[int]:
        """Edges of the ranges of this hop inside a range of the hop before, in the space of keys of so many bits."""
        count = self.fan**hop
        return [(i << bits) // count for i in range(parent * self.fan, (parent + 1) * self.fan + 1)]


def cut_up(keys: list[np.ndarray], network: Network, hop: int, parent: int, bits: int) -> list[np.ndarray]:
    """For each kind of sorted keys the places where the ranges of a hop begin, and the end."""
    out = []
    for k, b in zip(keys, (64, bits, bits), strict=False):
        edges = network.bounds(hop, parent, b)
        out.append(np.append(np.searchsorted(k, np.array(edges[:-1], np.uint64)), len(k)))
    return out


#: Blocks on their way: node (group and range) they go to, src and the range there that they are of, sizes by kind, keys, counts.
BLOCK = "node string, src string, part bigint, n array<int>, a binary, b binary, deleted boolean"
_BLOCK = [("node", pa.string()), ("src", pa.string()), ("part", pa.int64()), ("n", pa.list_(pa.int32())), ("a", pa.binary()), ("b", pa.binary()), ("deleted", pa.bool_())]


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.Table.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _name(hop: int, group: int, part: int) -> str:
    return f"{hop}:{group}:{part}"


def _sent(src: str, group: int, keys: list[np.ndarray], counts: list[np.ndarray], network: Network, hop: int, parent: int, bits: int, deleted: bool, z) -> Iterator[tuple]:
    """The blocks of a node for a hop: one for each range that it has keys of. counts: one or two (all, deleted) rows."""
    at = cut_up(keys, network, hop, parent, bits)
    for i in range(network.fan):
        n = [int(e[i + 1] - e[i]) for e in at]
        if sum(n):
            own = [slice(int(e[i]), int(e[i + 1])) for e in at]
            delta = np.concatenate([np.diff(k[o], prepend=U8(0)) for k, o in zip(keys, own, strict=True)])
            count = np.concatenate([c[:, o] for c, o in zip(counts, own, strict=True)], axis=1).ravel()
            part = parent * network.fan + i
            yield _name(hop, group, part), src, part, n, deflate(delta, z), deflate(count.astype("<u4" if hop == 1 else "<u8"), z), deleted


def counted(made: DataFrame, network: Network, bits: int, order: int) -> DataFrame:
    """Blocks of all shards for the first hop: the shard's n-grams in a range and their training counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = unpacked(data.as_py())
                tokens, train = Tokens(rows.column(1), bits, order), parts_of(rows.column(0)) != HELD
                keys, counts = [], []
                for i, grams in enumerate(tokens.grams):
                    each = train[tokens.doc]
                    if i == 0:  # the start of a text is a context
                        grams, each = np.append(grams, np.full(len(train), _START)), np.append(each, train)
                    place = np.argsort(grams)
                    grams = grams[place]
                    at = run_starts(grams)
                    keys.append(grams[at])
                    counts.append(np.add.reduceat(each[place].astype(np.int64), at)[None] if len(at) else np.zeros((1, 0), np.int64))
                out = list(_sent(str(name), (name >> 1) % network.groups[0], keys, counts, network, 1, 0, bits, name % 2 == 1, z))
                for i in range(0, len(out), 64):  # few blocks in a batch, so that batches stay small
                    yield _table(out[i : i + 64], _BLOCK).combine_chunks().to_batches()[0]

    return made.mapInArrow(run, BLOCK)


class Merged:
    """The blocks of a node put together: distinct keys by kind with their counts, and where each block's keys are among them."""

    def __init__(self, table: pa.Table, hop: int):
        d = zstandard.ZstdDecompressor()
        self.src, self.part, self.deleted = (table.column(c).to_pylist() for c in ("src", "part", "deleted"))
        self.sizes = table.column("n").to_pylist()
        kinds = len(self.sizes[0])
        keys, counts = [[] for _ in range(kinds)], [[] for _ in range(kinds)]
        rows = 1 if hop == 1 else 2
        for a, b, n, deleted in zip(table.column("a"), table.column("b"), self.sizes, self.deleted, strict=True):
            delta = inflate(a.as_py(), "<u8", sum(n), d)
            count = inflate(b.as_py(), "<u4" if hop == 1 else "<u8", rows * sum(n), d).reshape(rows, -1).astype(np.int64)
            if hop == 1:
                count = np.concatenate([count, count if deleted else np.zeros_like(count)])
            edge = np.append(0, np.cumsum(n))
            for k in range(kinds):
                keys[k].append(np.cumsum(delta[edge[k] : edge[k + 1]], dtype=U8))
                counts[k].append(count[:, edge[k] : edge[k + 1]])
        self.keys, self.sums, self.back = [], [], []
        for k in range(kinds):
            all_, c = np.concatenate(keys[k]), np.concatenate(counts[k], axis=1)
            place = np.argsort(all_, kind="stable")
            at = run_starts(all_[place])
            group = np.zeros(len(all_), np.int64)
            group[at[1:]] = 1
            back = np.empty(len(all_), np.int64)
            back[place] = np.cumsum(group)
            self.keys.append(all_[place][at])
            self.sums.append(np.add.reduceat(c[:, place], at, axis=1) if len(at) else np.zeros((2, 0), np.int64))
            self.back.append(np.split(back, np.cumsum([n[k] for n in self.sizes])[:-1]))


#: What a hop gives out: blocks for the next one, and for the way back where each block's keys are.
HOP = f"{BLOCK}, kind string"
#: Totals on their way back: the node, the range that they are of, sizes by kind, total and deleted counts; and sums of words.
BACK = "node string, part bigint, n array<int>, a binary, b binary, n_tokens bigint, n_types bigint, left_tokens bigint, left_types bigint"
_BACK = [("node", pa.string()), ("part", pa.int64()), ("n", pa.list_(pa.int32())), ("a", pa.binary()), ("b", pa.binary()), *((c, pa.int64()) for c in ("n_tokens", "n_types", "left_tokens", "left_types"))]


def hopped(blocks: DataFrame, network: Network, hop: int, bits: int) -> DataFrame:
    """A hop that is not the last: merge what came to each node, send it on, and note the way back."""

    def run(table: pa.Table) -> pa.Table:
        z = zstandard.ZstdCompressor(level=1)
        node = table.column("node")[0].as_py()
        _, group, part = map(int, node.split(":"))
        m = Merged(table, hop)
        out = [(*r, "block") for r in _sent(node, group % network.groups[hop], m.keys, m.sums, network, hop + 1, part, bits, False, z)]
        for i, (src, n) in enumerate(zip(m.src, m.sizes, strict=True)):
            back = np.concatenate([np.diff(b[i], prepend=0) for b in m.back])
            out.append((node, src, part, n, deflate(back.astype("<u4"), z), b"", False, "back"))
        return _table(out, [*_BLOCK, ("kind", pa.string())])

    return blocks.groupBy("node").applyInArrow(run, HOP)


def totalled(blocks: DataFrame, hop: int) -> DataFrame:
    """The last hop: for every block the total counts of its n-grams, in its order; and for each range (node null) the words' sums."""

    def add(table: pa.Table) -> pa.Table:
        z = zstandard.ZstdCompressor(level=1)
        m = Merged(table, hop)
        rows = [_returned(src, m.part[0], n, [[s[:, b[i]] for s, b in zip(m.sums, m.back, strict=True)]], z) for i, (src, n) in enumerate(zip(m.src, m.sizes, strict=True))]
        word = m.keys[0] != _START
        total, deleted = m.sums[0][0][word], m.sums[0][1][word]
        rows.append((None, m.part[0], [], b"", b"", int(total.sum()), int((total > 0).sum()), int((total - deleted).sum()), int((total > deleted).sum())))
        return _table(rows, _BACK)

    return blocks.groupBy("node").applyInArrow(add, BACK)


def _returned(node: str, part: int, n: list[int], sums: list[list[np.ndarray]], z) -> tuple:
    both = [np.concatenate(x, axis=1) for x in sums][0]
    return node, part, n, deflate(both[0].astype("<u8"), z), deflate(both[1].astype("<u8"), z), 0, 0, 0, 0


def collected(part: list[int], sizes: list[list[int]], a: list[bytes], b: list[bytes]) -> list[np.ndarray]:
    """What came back to a node from its ranges, in their order: (2, n) total and deleted counts for each kind."""
    d = zstandard.ZstdDecompressor()
    kinds: list[list[np.ndarray]] = [[] for _ in range(max(map(len, sizes), default=0))]
    for i in sorted(range(len(part)), key=part.__getitem__):
        count = np.stack([inflate(x[i], "<u8", sum(sizes[i]), d) for x in (a, b)]).astype(np.int64)
        edge = np.append(0, np.cumsum(sizes[i]))
        for k in range(len(kinds)):
            kinds[k].append(count[:, edge[k] : edge[k + 1]])
    return [np.concatenate(x, axis=1) for x in kinds]


def back_down(totals: DataFrame, ways: DataFrame) -> DataFrame:
    """Totals that came back to a hop's nodes, sent on to those that the nodes' blocks were of."""

    def run(table: pa.Table) -> pa.Table:
        z, d = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        rows = table.to_pylist()
        came, went = [r for r in rows if r["src"] is None], [r for r in rows if r["src"] is not None]
        sums = collected(*([r[c] for r in came] for c in ("part", "n", "a", "b")))
        out = []
        for r in went:
            place = inflate(r["a"], "<u4", sum(r["n"]), d).astype(np.int64)
            edge = np.append(0, np.cumsum(r["n"]))
            own = [s[:, np.cumsum(place[edge[k] : edge[k + 1]])] for k, s in enumerate(sums)]
            out.append(_returned(r["src"], r["part"], r["n"], [own], z))
        return _table(out, _BACK)

    here = totals.where("node is not null").select("node", F.lit(None).cast("string").alias("src"), "part", "n", "a", "b")
    return here.unionByName(ways.select("node", "src", "part", "n", "a", "b")).groupBy("node").applyInArrow(run, BACK)


class Shard:
    """A shard's tokens with the counts of its n-grams and of their contexts, all or without the deleted part."""

    def __init__(self, table: pa.Table, bits: int, order: int):
        part, sizes = table.column("part").to_pylist(), table.column("n").to_pylist()
        own = [i for i, p in enumerate(part) if p < 0]
        if len(own) != 1:
            raise ValueError("a shard needs its own row once")
        a, b = (table.column(c) for c in ("a", "b"))
        self.rows = unpacked(a[own[0]].as_py())
        rest = [i for i in range(len(part)) if i != own[0]]
        sums = collected([part[i] for i in rest], [sizes[i] for i in rest], [a[i].as_py() for i in rest], [b[i].as_py() for i in rest])
        t = Tokens(self.rows.column(1), bits, order)
        self.part, self.doc, self.n = parts_of(self.rows.column(0)), t.doc, t.n
        self.counts = []  # (2, tokens) of each order
        for k, grams in enumerate(t.grams):
            unique, place = np.unique(np.append(grams, _START) if k == 0 else grams, return_inverse=True)
            if len(unique) != sums[k].shape[1]:
                raise ValueError("a shard's n-grams are not those that were counted")
            if k == 0:
                self.start, place = sums[0][:, place[-1]], place[:-1]
            self.counts.append(sums[k][:, place])

    def of(self, left: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Counts of words, pairs (and triples), and of the contexts of all but words; ``left``: without the deleted part."""
        minus = lambda c: c[0] - c[1] if left else c[0]
        counts = [minus(c) for c in self.counts]
        return counts, [previous(c, self.n, minus(self.start)) for c in counts[:-1]]


def level(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's count: 0 if it has none, else 1 + its binary logarithm, cut down."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def share(count: np.ndarray, context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, count / np.maximum(context, 1), 0.0)


def rounded(ratio: np.ndarray) -> np.ndarray:
    return np.minimum(CELLS - 1, np.rint(STEPS * np.log1p(ratio))).astype(np.int64)


def pairs_part(counts: list[np.ndarray], contexts: list[np.ndarray], tokens: int, types: int, w: np.ndarray) -> np.ndarray:
    """p2: words and pairs mixed by the weights of the context's bucket; without a context's count the others take the pairs' weight."""
    lam = w[np.minimum(level(contexts[0]), BUCKETS - 1)]
    known = contexts[0] > 0
    rest = np.where(known, 1.0, lam[:, 1] + lam[:, 2])
    return (np.where(known, lam[:, 0], 0.0) * share(counts[1], contexts[0]) + lam[:, 1] * counts[0] / max(1, tokens) + lam[:, 2] / (types + 1)) / rest


def probability(counts: list[np.ndarray], contexts: list[np.ndarray], tokens: int, types: int, w: np.ndarray, w3: np.ndarray | None) -> np.ndarray:
    p = pairs_part(counts, contexts, tokens, types, w)
    if w3 is None:
        return p
    lam = np.where(contexts[1] > 0, w3[np.minimum(level(contexts[1]), BUCKETS - 1)], 0.0)
    return lam * share(counts[2], contexts[1]) + (1 - lam) * p


def evidence(tokens: int, types: int, bits: int, order: int, w: np.ndarray | None = None):
    """EM's events of a shard of the deleted part: how many of its tokens have which bucket and (rounded) ratios.

    Without weights: pairs and words against the uniform estimate; with those of p2: triples against p2.
    """

    def count(table: pa.Table) -> pa.Table:
        s = Shard(table, bits, order)
        counts, contexts = s.of(left=True)
        if w is None:
            r2, r1 = share(counts[1], contexts[0]) * (types + 1), counts[0] / max(1, tokens) * (types + 1)
            cells = (level(contexts[0]) * CELLS + rounded(r2)) * CELLS + rounded(r1)
        else:
            cells = level(contexts[1]) * CELLS + rounded(share(counts[2], contexts[1]) / pairs_part(counts, contexts, tokens, types, w))
        cell, n = np.unique(cells, return_counts=True)
        return pa.table({"cell": pa.array(cell), "n": pa.array(n.astype(np.int64))})

    return count


def weights(cells: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """For each bucket the weights (pair, word, uniform); one pseudo-event for each keeps them above 0."""
    out = np.full((BUCKETS, 3), 1 / 3)
    bucket = cells // (CELLS * CELLS)
    r = np.stack([np.expm1(cells // CELLS % CELLS / STEPS), np.expm1(cells % CELLS / STEPS), np.ones(len(cells))])
    for b in range(BUCKETS):
        own = bucket == b
        if not own.any():
            out[b] = out[b - 1] if b > 1 else (1e-9, 0.5, 0.5) if b == 0 else out[b]
            continue
        x, n, w = r[:, own], counts[own].astype(float), np.full(3, 1 / 3)
        for _ in range(rounds):
            part = w[:, None] * x
            w = (part / part.sum(0)) @ n + 1.0
            w /= w.sum()
        out[b] = w
    return out


def longer_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """For each bucket of a longer context's count its weight against the shorter ones: 0 without a count; EM with two pseudo-events."""
    out = np.zeros(BUCKETS)
    bucket, r = cells // CELLS, np.expm1(cells % CELLS / STEPS)
    for b in range(1, BUCKETS):
        own = bucket == b
        if not own.any():
            out[b] = out[b - 1] if b > 1 else 0.5
            continue
        x, n, w = r[own], counts[own].astype(float), 0.5
        for _ in range(rounds):
            w = (float((w * x / (w * x + 1 - w)) @ n) + 1) / (n.sum() + 2)
        out[b] = w
    return out


def score(docs: DataFrame, text: str = "text", id_col: str = "doc_id", order: int = ORDER) -> DataFrame:
    """Score all documents with a model of those outside the held-out part, of words and pairs (order 2) or triples too (3).

    Returns id_col, held_out, n_tokens (with the end), n_known, train_tokens, base_score (add-one unigram) and
    score, both as log10 of the text's probability. Nulls and empty texts have the end token alone. A null id
    is a training document. Repeated rows count as often as they occur. Without training tokens every
    estimate is uniform. Extra columns are ignored.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    size = int(docs.agg(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0)
    bits = key_bits(size)
    made = keep(dealt(docs, text, id_col), "shards", codec="uncompressed")
    network = Network(made.count(), max(1, -(-size // BUCKET)), FAN)
    blocks, ways = counted(made, network, bits, order), []
    for hop in range(1, network.hops):
        gone = keep(hopped(blocks, network, hop, bits), "hop", codec="uncompressed")
        ways.append(gone.where("kind = 'back'"))
        blocks = gone.where("kind = 'block'").drop("kind")
    totals = keep(totalled(blocks, network.hops), "totals", codec="uncompressed")
    stats = [int(x or 0) for x in totals.where("node is null").agg(*(F.sum(c) for c in ("n_tokens", "n_types", "left_tokens", "left_types"))).first()]
    tokens, types, left_tokens, left_types = stats
    for way in reversed(ways):
        totals = keep(back_down(totals, way), "totals", codec="uncompressed")
    came = totals.where("node is not null").select(F.col("node").cast("bigint").alias("shard"), "part", "n", "a", "b")
    own = made.select("shard", F.lit(-1).cast("long").alias("part"), F.array().cast("array<int>").alias("n"), "a", F.lit(None).cast("binary").alias("b"))

    def learned(w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """EM's events, a histogram of some thousand cells whatever the corpus (at most BUCKETS x CELLS x CELLS)."""
        cells = own.unionByName(came).where("shard % 2 = 1").groupBy("shard").applyInArrow(evidence(left_tokens, left_types, bits, order, w), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
        found = keep(cells, "cells").toPandas()
        return found["cell"].to_numpy(np.int64), found["n"].to_numpy(np.int64)

    w = weights(*learned(None))
    w3 = longer_weights(*learned(w)) if order > 2 else None
    kind = dict(docs.dtypes)[id_col]

    def finish(table: pa.Table) -> pa.Table:
        s = Shard(table, bits, order)
        counts, contexts = s.of(left=False)
        n = len(s.n)
        add = lambda x: np.bincount(s.doc, weights=x, minlength=n)
        p = probability(counts, contexts, tokens, types, w, w3)
        base = np.log10((counts[0] + 1) / (tokens + types + 1))
        return pa.Table.from_arrays(
            [s.rows.column(0), pa.array(s.part == HELD), pa.array(s.n.astype(np.int64)), pa.array(add(counts[0] > 0).astype(np.int64)), pa.array(np.full(n, tokens, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))],
            [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    whole = own.unionByName(came)
    return whole.groupBy("shard").applyInArrow(finish, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
