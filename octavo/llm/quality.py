"""Quality classifier: a second-order factorisation machine.

Inputs are hashed words (weighted by 1 + log of their count, each text's words scaled to length 1), structure
statistics in bins, and the size as metadata. Pairwise interactions have rank RANK and are summed in linear
time: half of the square of the sum less the sum of squares, for each factor.

Learned on the driver from at most about SAMPLE labelled documents (a fixed bound, chosen by a hash of the
id); texts are turned into features by the workers, as for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from octavo.llm.blocks import NONSPACE, PAD, U8, column_bytes, mix, run_starts, shards, span_hash, word_spans
from octavo.llm.shared import keep, sized

SAMPLE = 6000
FOLDS, HELD = 5, 0
WORDS, BINS, RANK = 1 << 16, 16, 8
EPOCHS, BATCH, RATE = 6, 128, 0.03
#: From this score on a document counts as good.
GOOD = 0.3

_CLASS = np.zeros(256, np.uint8)  # 1 upper case, 2 lower case, 3 digit, 4 white space, 5 sentence mark, 6 other sign, 0 non-ASCII
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:?'-\"()"]] = 5
_CLASS[[b for b in range(33, 127) if _CLASS[b] == 0]] = 6
STATISTICS = ("bytes", "words", "word_length", "upper", "digit", "space", "mark", "sign", "foreign", "line_words", "repeated_lines", "distinct_words", "top_word", "short_words", "sign_ends", "chars")
DIM = WORDS + len(STATISTICS) * BINS


def _per_text(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[offs[1:]] - total[offs[:-1]]


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and the largest count of one."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    at = run_starts(d, k)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(d))))
    return np.bincount(d[at], minlength=n), most


def features(column: pa.Array, chars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts, and offsets. ``chars``: the size given as metadata, else counted."""
    raw, offs = column_bytes(column)
    n = len(offs) - 1
    m, starts, ends, doc = word_spans(raw, offs, NONSPACE)
    size = np.diff(offs)
    kinds = _CLASS[raw]
    share = lambda k: _per_text(kinds == k, offs) / np.maximum(size, 1)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    length = ends - starts
    h = span_hash(m, starts, ends)
    distinct, top = _distinct(doc, h, n)
    # lines
    edges = np.union1d(np.flatnonzero(raw == 10) + 1, offs)
    edges = edges[edges <= len(raw)]
    begin, stop = edges[:-1], edges[1:]
    padded = np.zeros(len(raw) + PAD, np.uint8)
    padded[: len(raw)] = raw
    stop = np.where(raw[stop - 1] == 10, stop - 1, stop) if len(stop) else stop
    full = stop > begin
    begin, stop = begin[full], stop[full]
    line_doc = np.searchsorted(offs, begin, side="right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    own_lines, _ = _distinct(line_doc, span_hash(padded, begin, stop), n)
    last = kinds[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    by_word = lambda flag: np.bincount(doc, weights=flag, minlength=n) / some
    if chars is None:
        chars = _per_text((raw & 0xC0) != 0x80, offs)
    stats = np.stack([
        np.log2(size + 1) / 20, np.log2(words + 1) / 17, np.bincount(doc, weights=length, minlength=n) / some / 16,
        share(1), share(3) * 4, share(4) * 2, share(5) * 4, share(6) * 4, share(0),
        np.log2(words / np.maximum(n_lines, 1) + 1) / 12, 1 - own_lines / np.maximum(n_lines, 1), distinct / some, top / some,
        by_word(length <= 3), by_word(last == 6), np.log2(np.maximum(chars, 0) + 1) / 20,
    ], 1)
    stat_bin = np.clip((stats * BINS).astype(np.int64), 0, BINS - 1) + np.arange(len(STATISTICS)) * BINS + WORDS
    # words: distinct (text, slot) with counts
    slot = (mix(h) >> U8(48)).astype(np.int64) % WORDS
    key = np.sort(doc.astype(np.int64) * WORDS + slot)
    at = run_starts(key)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    d, value = key // WORDS, 1 + np.log(count)
    norm = np.sqrt(np.bincount(d, weights=value**2, minlength=n))
    value = value / norm[d] if len(d) else value
    k = len(STATISTICS)
    owner = np.concatenate([d, np.repeat(np.arange(n), k)])
    order = np.argsort(owner, kind="stable")
    index = np.concatenate([key % WORDS, stat_bin.ravel()])[order]
    values = np.concatenate([value, np.full(n * k, 1 / np.sqrt(k))])[order]
    return index, values.astype(np.float32), np.append(0, np.cumsum(np.bincount(owner, minlength=n)))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the factor sums (texts x RANK) on the way; every text has features."""
        vx = self.factors[index] * values[:, None]
        sums = np.add.reduceat(vx, offs[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), offs[:-1])
        return self.bias + np.add.reduceat(self.linear[index] * values, offs[:-1]) + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, index: np.ndarray, values: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if len(offs) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(index, values, offs)[0].astype(np.float64), -60, 60)))


def train(index: np.ndarray, values: np.ndarray, offs: np.ndarray, label: np.ndarray) -> Machine:
    """Fit by Adagrad on the logistic loss, in small batches."""
    rng = np.random.default_rng(7)
    n = len(label)
    prior = (label.sum() + 1) / (n + 2)
    machine = Machine(float(np.log(prior / (1 - prior))), np.zeros(DIM, np.float32), rng.normal(0, 0.05, (DIM, RANK)).astype(np.float32))
    g_linear, g_factors, g_bias = np.full(DIM, 1e-3, np.float32), np.full((DIM, RANK), 1e-3, np.float32), 1e-3
    # small samples get more passes, for about as many steps
    for _ in range(min(8 * EPOCHS, max(EPOCHS, EPOCHS * SAMPLE // n)) if n else 0):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            rows = order[a : a + BATCH]
            size = offs[rows + 1] - offs[rows]
            o = np.append(0, np.cumsum(size))
            at = np.arange(int(o[-1])) - np.repeat(o[:-1] - offs[rows], size)
            i, x = index[at], values[at]
            logit, sums = machine.raw(i, x, o)
            error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - label[rows]).astype(np.float32)
            own = np.repeat(np.arange(len(rows)), size)
            e = error[own] * x
            used, code = np.unique(i, return_inverse=True)
            grad = np.bincount(code, weights=e, minlength=len(used)).astype(np.float32) / len(rows) * 16 + 1e-5 * machine.linear[used]
            v = machine.factors[i]
            each = e[:, None] * (sums[own] - v * x[:, None])
            grads = np.stack([np.bincount(code, weights=each[:, k], minlength=len(used)) for k in range(RANK)], 1).astype(np.float32) / len(rows) * 16 + 1e-5 * machine.factors[used]
            g_linear[used] += grad**2
            g_factors[used] += grads**2
            machine.linear[used] -= RATE * 4 * grad / np.sqrt(g_linear[used])
            machine.factors[used] -= RATE * grads / np.sqrt(g_factors[used])
            g = float(error.mean())
            g_bias += g * g
            machine.bias -= RATE * g / g_bias**0.5
    return machine


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", size: str | None = None, sample: int = SAMPLE) -> Machine:
    """Learn from labelled documents outside the held-out fold. Null labels are ignored, repeated ones count again."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != HELD)).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
    share = int(min(1.0, sample / max(1, known.count())) * (1 << 30))
    known = known.where(F.pmod(F.xxhash64(F.lit(5), F.col("_id")), F.lit(1 << 30)) < share)
    # about ``sample`` rows with an id and a number each, unless one id has many labels
    known = keep(known, "labels")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), *([F.col(size).cast("long").alias("_size")] if size else [])).join(sized(known), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "_text"):
            index, values, offs = features(shard.column(1), given(shard, "_size"))
            flat = [pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(x)) for x in (index.astype(np.int32), values)]
            yield pa.RecordBatch.from_arrays([shard.column(0), shard.column(shard.num_columns - 1), *flat], ["_id", "_label", "i", "x"])

    kind = dict(rows.dtypes)["_id"]
    found = rows.mapInArrow(run, f"_id {kind}, _label int, i array<int>, x array<float>").toArrow().combine_chunks()
    if not found.num_rows:
        return train(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0))
    found = found.sort_by([("_id", "ascending"), ("_label", "ascending")])
    lists = found.column("i").combine_chunks(), found.column("x").combine_chunks()
    lengths = np.asarray(lists[0].value_lengths())
    return train(np.asarray(lists[0].flatten()).astype(np.int64), np.asarray(lists[1].flatten()), np.append(0, np.cumsum(lengths)), found.column("_label").to_numpy().astype(np.float32))


def given(shard: pa.RecordBatch, name: str) -> np.ndarray | None:
    at = shard.schema.get_field_index(name)
    return None if at < 0 else np.asarray(shard.column(at).fill_null(0)).astype(np.int64)


def score(docs: DataFrame, machine: Machine, text: str = "text", size: str | None = None) -> DataFrame:
    """All columns of docs but the text, and score (0 to 1), predicted (1 from GOOD on).

    Null texts count as empty, which have a score too. Columns of docs named like a new one give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # DIM x (RANK + 1) numbers: a fixed size
    kept = [f for f in docs.schema.fields if f.name.lower() not in (text.lower(), "score", "predicted")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, text):
            s = shared.value.score(*features(shard.column(shard.schema.get_field_index(text)), given(shard, size) if size else None))
            yield pa.RecordBatch.from_arrays([*(shard.column(shard.schema.get_field_index(x)) for x in names), pa.array(s), pa.array((s >= GOOD).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*kept, *StructType.fromDDL("score double, predicted int").fields]))
