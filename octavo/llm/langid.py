"""Language identification of words by a linear-chain conditional random field.

Words are labelled line by line with forward-backward; their scores come from affixes, letter n-grams and
lexicons by hashed weights, and from learned transitions, so that a text may switch its language. A
document's prediction is the language with the largest mean posterior over its words, its score that mean.

Training takes whole texts of at most SAMPLE labelled documents (a fixed bound, chosen by a hash of the id).
A line's words carry the document's label; lines spliced from two languages teach the switches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from octavo.llm.blocks import LETTERS, U8, column_bytes, mix, release, shards, span_hash, word_spans

#: Labelled documents from which the model is learned.
SAMPLE = 1500
#: Folds by crc32(id): documents of fold HELD are never learned from.
FOLDS, HELD = 4, 2
DIM = 1 << 16
#: A word of the lexicons occurs so often in the sample; each lexicon has at most so many words.
LEXICON_COUNT, LEXICON_SIZE = 4, 20_000
EPOCHS, PARTS, RATE = 5, 6, 0.08
#: Bytes of text labelled at a time, and distinct words whose features are made at a time.
SHARD, AT_ONCE = 1 << 20, 1 << 13
UNDETERMINED = "und"
_K = [U8(0x9E3779B97F4A7C15), U8(0xC2B2AE3D27D4EB4F), U8(0x165667B19E3779F9), U8(0x27D4EB2F165667C5)]


def _slot(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> U8(48)).astype(np.int64)


def word_features(m: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, and their offsets: letter pairs and triples of ^word$, affixes of 3 and 4 bytes, the word."""
    n = len(starts)
    size = ends - starts + 2
    offs = np.append(0, np.cumsum(size))
    x = np.empty(int(offs[-1]), U8)
    inner = np.arange(int(offs[-1])) - np.repeat(offs[:-1], size)
    source = np.repeat(starts - 1, size) + inner
    x[:] = m[np.clip(source, 0, len(m) - 1)]
    x[offs[:-1]], x[offs[1:] - 1] = 1, 2
    owner = np.repeat(np.arange(n), size)
    left = np.repeat(offs[1:], size) - np.arange(len(x))  # symbols from here to the word's end
    out, own = [], []
    for k in (2, 3):
        at = np.flatnonzero(left >= k)
        h = x[at] * _K[0]
        for j in range(1, k):
            h = h * _K[1] + x[at + j]
        out.append(_slot(h * U8(8) + U8(k)))
        own.append(owner[at])
    for k in (4, 5):
        long = np.flatnonzero(size >= k)
        for side, first in ((1, offs[:-1][long]), (2, offs[1:][long] - k)):
            h = np.full(len(long), U8(side * 16 + k))
            for j in range(k):
                h = h * _K[2] + x[first + j]
            out.append(_slot(h))
            own.append(long)
    out.append(_slot(span_hash(m, starts, ends) * _K[3]))
    own.append(np.arange(n))
    own = np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return np.concatenate(out)[order], np.append(0, np.cumsum(np.bincount(own, minlength=n)))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIM x languages
    lexicon: np.ndarray  # sorted word hashes
    members: np.ndarray  # lexicon rows x languages, 0 or 1
    lexicon_weights: np.ndarray  # languages (whose lexicon) x languages
    transitions: np.ndarray
    start: np.ndarray

    def lexical(self, hashes: np.ndarray) -> np.ndarray:
        """Membership of words in each language's lexicon."""
        if not len(self.lexicon):
            return np.zeros((len(hashes), len(self.languages)), np.float32)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return self.members[at] * (self.lexicon[at] == hashes)[:, None]

    def emissions(self, m: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Scores of each distinct word for each language."""
        out = np.empty((len(starts), len(self.languages)), np.float32)
        for a in range(0, len(starts), AT_ONCE):
            f, offs = word_features(m, starts[a : a + AT_ONCE], ends[a : a + AT_ONCE])
            out[a : a + AT_ONCE] = np.add.reduceat(self.weights[f], offs[:-1], axis=0)
        return out + self.lexical(hashes) @ self.lexicon_weights


def marginals(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posterior of every label of every word; chains lie in ``scores`` from ``begin`` on, each of ``size`` >= 1 words.

    All chains advance together, the longest first; with ``pairs`` also the expected transitions and starts.
    """
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    t = np.exp(transitions)
    alpha = np.empty_like(e)
    now = np.exp(start)[None, :] * e[begin]
    for s in range(steps):
        k = active[s]
        if s:
            now = (now[:k] @ t) * e[begin[:k] + s]
        now = now / now.sum(1, keepdims=True)
        alpha[begin[:k] + s] = now
    beta = np.ones_like(e)
    expected = np.zeros_like(t)
    back = np.ones((0, e.shape[1]))
    for s in range(steps - 2, -1, -1):
        k = active[s + 1]
        after = np.ones((k, e.shape[1]))
        after[: len(back)] = back
        at = begin[:k] + s
        onward = e[at + 1] * after
        if pairs:
            a = alpha[at]
            norm = ((a @ t) * onward).sum(1, keepdims=True)
            expected += t * (a.T @ (onward / norm))
        back = onward @ t.T
        back /= back.sum(1, keepdims=True)
        beta[at] = back
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    return (post, expected, post[begin].sum(0)) if pairs else post


def lines(raw: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains: first word and number of words of each line that has words."""
    row = np.searchsorted(np.flatnonzero(raw == 10), starts)
    new = np.append(True, (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])) if len(starts) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(starts)))


def train(texts: list[str], labels: list[str]) -> Model:
    """Fit by Adam on the chains' log-likelihood."""
    languages = sorted(set(labels))
    size = len(languages)
    raw, offs = column_bytes(pa.array(texts, pa.string()))
    m, starts, ends, doc = word_spans(raw, offs, LETTERS)
    hashes = span_hash(m, starts, ends)
    codes, unique = pd.factorize(hashes)
    where = np.zeros(len(unique), np.int64)
    where[codes[::-1]] = np.arange(len(codes))[::-1]
    label = np.array([languages.index(x) for x in labels], np.int64)[doc] if len(texts) else np.zeros(0, np.int64)
    counts = np.stack([np.bincount(codes[label == k], minlength=len(unique)) for k in range(size)], 1) if size else np.zeros((len(unique), 0))
    in_any = np.zeros(len(unique), bool)
    members = np.zeros((len(unique), size), np.float32)
    for k in range(size):
        top = np.argsort(-counts[:, k], kind="stable")[:LEXICON_SIZE]
        top = top[counts[top, k] >= LEXICON_COUNT]
        members[top, k] = 1
        in_any[top] = True
    rows = np.flatnonzero(in_any)
    rows = rows[np.argsort(unique[rows])]
    model = Model(languages, np.zeros((DIM, size), np.float32), unique[rows], members[rows], np.zeros((size, size), np.float32), np.zeros((size, size)), np.zeros(size))
    if not len(starts) or size < 2:
        return model
    begin, length = lines(raw, starts, doc)
    rng = np.random.default_rng(11)
    # Chains as lists of word numbers: half of the lines as they are, half with a run of another line inside.
    chains, made = np.split(np.arange(len(starts)), begin[1:]), []
    for i, other in enumerate(rng.permutation(len(chains)).tolist()):
        own = chains[i]
        if i % 2 and label[own[0]] != label[chains[other][0]]:
            cut, run = rng.integers(0, len(own) + 1), chains[other][: rng.integers(1, len(own) + 2)]
            own = np.concatenate([own[:cut], run, own[cut:]])
        made.append(own)
    parts = np.array_split(rng.permutation(len(made)), min(PARTS, len(made)))
    params = [model.weights.astype(np.float64), model.lexicon_weights.astype(np.float64), model.transitions, model.start]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for part in parts:
            words = np.concatenate([made[i] for i in part])
            sizes = np.array([len(made[i]) for i in part])
            at = np.cumsum(sizes) - sizes
            local, types = pd.factorize(codes[words])
            lexical = model.lexical(unique[types])
            emission, made_of = lexical @ params[1], []  # the features of some words at a time, in two bytes each
            for a in range(0, len(types), AT_ONCE):
                f, fo = word_features(m, starts[where[types[a : a + AT_ONCE]]], ends[where[types[a : a + AT_ONCE]]])
                emission[a : a + AT_ONCE] += np.add.reduceat(params[0][f], fo[:-1], axis=0)
                made_of.append((f.astype(np.uint16), np.diff(fo)))
            post, expected, began = marginals(emission[local], at, sizes, params[2], params[3], pairs=True)
            truth = label[words]
            inside = np.ones(len(words), bool)
            inside[at] = False
            to = np.flatnonzero(inside)
            seen = np.bincount(truth[to - 1] * size + truth[to], minlength=size * size).reshape(size, size)
            post[np.arange(len(words)), truth] -= 1
            by_type = np.stack([np.bincount(local, weights=post[:, k], minlength=len(types)) for k in range(size)], 1)
            by_feature = np.zeros((DIM, size))
            for i, (f, count) in enumerate(made_of):
                own = by_type[i * AT_ONCE : (i + 1) * AT_ONCE]
                for k in range(size):
                    by_feature[:, k] += np.bincount(f, weights=np.repeat(own[:, k], count), minlength=DIM)
            grads = [
                by_feature,
                lexical.T @ by_type,
                expected - seen,
                began - np.bincount(truth[at], minlength=size),
            ]
            step += 1
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = g / len(words) * 100 + 1e-4 * p
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                p -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)
    model.weights, model.lexicon_weights, model.transitions, model.start = params[0].astype(np.float32), params[1].astype(np.float32), params[2], params[3]
    return model


def word_posteriors(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, document numbers and label posteriors of all words."""
    raw, offs = column_bytes(column)
    m, starts, ends, doc = word_spans(raw, offs, LETTERS)
    if not len(starts) or not model.languages:
        return starts, ends, doc, np.ones((len(starts), len(model.languages)))
    codes, unique = pd.factorize(span_hash(m, starts, ends))
    where = np.zeros(len(unique), np.int64)
    where[codes[::-1]] = np.arange(len(codes))[::-1]
    scores = model.emissions(m, starts[where], ends[where], unique)[codes]
    begin, size = lines(raw, starts, doc)
    return starts, ends, doc, marginals(scores, begin, size, model.transitions, model.start)


def has_letter(column: pa.Array) -> np.ndarray:
    raw, offs = column_bytes(column)
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    total = np.append(0, np.cumsum(ascii_letter))
    out = total[offs[1:]] > total[offs[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)).tolist():
        out[i] = any(map(str.isalpha, column[i].as_py()))
    return out


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from at most about ``sample`` documents outside the held-out fold, spread by a hash of the id."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(id_col) != HELD))
    n = known.select(lang).count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 30))
    rows = known.where(F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1 << 30)) < share).select(text, lang, id_col).toPandas()
    rows = rows.sort_values([id_col, text])
    try:
        return train(rows[text].tolist(), rows[lang].tolist())
    finally:
        release()


def predict(docs: DataFrame, model: Model, text: str = "text", least: float | None = None) -> DataFrame:
    """All columns of docs, and lang_pred, score (0 to 1; 0 where undetermined).

    Null texts and texts without a letter are ``und``. Where nothing was learned, every text is. Columns of docs
    named like a new one give way. With ``least``, instead the rows of docs themselves that are determined with
    at least that score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages weights and the lexicons: bounded
    kept = [f for f in docs.schema.fields if least is not None or f.name.lower() not in ("lang_pred", "score")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for shard in shards(batches, text, SHARD):
            column = shard.column(shard.schema.get_field_index(text))
            _, _, doc, post = word_posteriors(model, column)
            n = shard.num_rows
            total = np.stack([np.bincount(doc, weights=post[:, k], minlength=n) for k in range(post.shape[1])], 1) if post.shape[1] else np.zeros((n, 1))
            ok = has_letter(column) & (total.sum(1) > 0)
            best = total.argmax(1)
            score = np.where(ok, total[np.arange(n), best] / np.maximum(total.sum(1), 1e-12), 0.0)
            if least is not None:
                yield shard.filter(pa.array(ok & (score >= least)))
                continue
            said = [model.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(shard.column(shard.schema.get_field_index(x)) for x in names), pa.array(said, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    made = [] if least is not None else StructType.fromDDL("lang_pred string, score double").fields
    return docs.mapInArrow(run, StructType([*kept, *made]))


def label_words(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Code-switched labelling: per document runs of words of one language (start and end in UTF-8 bytes, lang, words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for shard in shards(batches, text, SHARD):
            _, offs = column_bytes(shard.column(1))
            starts, ends, doc, post = word_posteriors(model, shard.column(1))
            out: list[list[dict]] = [[] for _ in range(shard.num_rows)]
            if len(starts) and model.languages:
                best = post.argmax(1)
                new = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])))
                for a, z in zip(new.tolist(), np.append(new[1:], len(best)).tolist(), strict=True):
                    base = int(offs[doc[a]])
                    out[doc[a]].append({"start": int(starts[a]) - base, "end": int(ends[z - 1]) - base, "lang": model.languages[best[a]], "words": z - a})
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([shard.column(0), pa.array(out, kinds)], [id_col, "runs"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, runs array<struct<start:int,end:int,lang:string,words:int>>")


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = 0.4) -> DataFrame:
    """The documents whose language is determined with at least the given score, with their columns."""
    return predict(docs, model, text, least)
