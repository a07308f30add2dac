"""Benchmark decontamination by suffix arrays over shards of the training texts.

Each shard of whole documents gets a suffix array over its words. Every benchmark suffix that is long
enough is binary-searched in it; the interval found holds all places where the words occur verbatim.
Runs of consecutive windows on one diagonal are merged into the longest matches.

The array is sparse: a suffix is kept only if its first words (up to three) begin some benchmark
suffix. All others can't be reached by any search, so no match is lost. Documents are never split or
shuffled; the work is one pass over the texts.

The benchmark reaches the workers in blocks of at most ``BLOCK_WORDS`` words. A benchmark of several
blocks is worked through block by block over the same rows; hits are merged by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from octavo.llm.blocks import ALNUM, U8, column_bytes, gather_ragged, mix, shards, span_hash, word_spans

#: Words of the benchmark in one broadcast block: some 40 MB in a worker while it is searched for. A proven bound.
BLOCK_WORDS = 200_000
WINDOW = 10
#: Low bits of a hash by which most words of a text are told to begin no suffix.
LOW = (1 << 20) - 1
_A, _B = U8(0x9E3779B97F4A7C15), U8(0xC2B2AE3D27D4EB4F)


def _gram(words: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q words from each position on; the last q - 1 positions have none."""
    n = max(0, len(words) - q + 1)
    h = words[:n].copy()
    for k in range(1, q):
        h = mix(h * _A + words[k : k + n] * _B)
    return h


class Tests:
    """One block of benchmark items: words, and the suffixes that can begin a match, with their least length."""

    def __init__(self, ids: list[str | None], words: list[np.ndarray], window: int):
        ids, words = zip(*[(i, w) for i, w in zip(ids, words, strict=True) if len(w)], strict=True) if any(map(len, words)) else ((), ())
        self.ids, self.window = list(ids), window
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size) - size if len(size) else size
        self.words = np.concatenate([*words, np.zeros(1, U8)])
        need = np.minimum(size, window)
        count = size - need + 1
        self.item = np.repeat(np.arange(len(size)), count)
        self.offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.start = np.repeat(first, count) + self.offset
        self.need = np.repeat(need, count)
        # by the number of first words (up to three): their distinct hashes, a table of their low bits, and the suffixes
        # that begin with each, in order of hash, with the places where those of each hash begin
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        full = np.concatenate([self.words, np.zeros(3, U8)])
        for q in (1, 2, 3):
            own = np.flatnonzero(np.minimum(self.need, 3) == q)
            if own.size:
                hashes = _gram(full, q)[self.start[own]]
                order = np.argsort(hashes, kind="stable")
                grams, at = np.unique(hashes[order], return_index=True)
                low = np.zeros(LOW + 1, bool)
                low[(grams & U8(LOW)).astype(np.int64)] = True
                self.grams[q] = grams, low, own[order], np.append(at, len(own))

    def __len__(self) -> int:
        return len(self.start)


def suffix_array(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the words from there on, to ``depth`` words: groups that still tie are refined word by word."""
    sa = places[np.argsort(words[places], kind="stable")]
    if not sa.size:
        return sa
    head = words[sa]
    group = np.zeros(len(sa), np.int64)
    group[1:] = np.cumsum(head[1:] != head[:-1])
    for d in range(1, depth):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not tied.size:
            break
        at = np.minimum(sa[tied] + d, len(words) - 1)
        key = words[at]
        order = np.lexsort((key, group[tied]))
        sa[tied], key = sa[tied][order], key[order]
        new = np.zeros(len(sa), bool)
        new[1:] = group[1:] != group[:-1]
        step = np.zeros(len(tied), bool)
        step[1:] = (key[1:] != key[:-1]) & (group[tied][1:] == group[tied][:-1])
        new[tied[step]] = True
        group = np.cumsum(new)
    return sa


def search(words: np.ndarray, sa: np.ndarray, tests: Tests, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the test suffixes ``which`` the interval of the suffix array that begins with its ``need`` words, by binary search."""
    step = np.arange(tests.window)
    want = np.concatenate([tests.words, np.zeros(tests.window, U8)])[tests.start[which][:, None] + step]
    live = step < tests.need[which][:, None]
    rows = np.arange(len(which))
    padded = np.concatenate([words, np.zeros(tests.window, U8)])

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(sa), np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = np.minimum((lo + hi) // 2, len(sa) - 1)
            have = padded[sa[mid][:, None] + step]
            differ = (have != want) & live
            at = differ.argmax(1)
            found = differ[rows, at]
            less = found & (have[rows, at] < want[rows, at])
            right = less | (~found if after else False)
            lo = np.where(open_ & right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)

    if not len(sa) or not len(which):
        return np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
    return bound(False), bound(True)


class Found:
    """Matched windows of a shard: test row, word position in the shard, and length."""

    def __init__(self, words: np.ndarray, sep: np.ndarray, tests: Tests):
        hit = np.zeros(len(words), bool)
        which = []  # only suffixes whose first words are somewhere in the shard can be found
        for q, (grams, low, rows, begin) in tests.grams.items():
            g = _gram(words, q)
            maybe = np.flatnonzero(low[(g & U8(LOW)).astype(np.int64)])
            at = np.minimum(np.searchsorted(grams, g[maybe]), len(grams) - 1)
            same = grams[at] == g[maybe]
            hit[maybe[same]] = True
            seen = np.unique(at[same])
            which.append(rows[gather_ragged(begin[seen], begin[seen + 1] - begin[seen])])
        hit[sep] = False
        which = np.sort(np.concatenate(which)) if which else np.zeros(0, np.int64)
        sa = suffix_array(words, np.flatnonzero(hit), tests.window)
        lo, hi = search(words, sa, tests, which)
        n = hi - lo
        self.test = np.repeat(which, n)
        self.place = sa[gather_ragged(lo, n)] if n.sum() else np.zeros(0, np.int64)
        self.need = tests.need[self.test]


def shard_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with a separator of 0 after each document; its positions; each word's document; words per document."""
    raw, offs = column_bytes(column)
    m, starts, ends, doc = word_spans(raw, offs, ALNUM)
    n = len(offs) - 1
    h = span_hash(m, starts, ends)
    h[h == 0] = 1
    count = np.bincount(doc, minlength=n)
    out = np.zeros(len(h) + n, U8)
    out[np.arange(len(h)) + doc] = h
    sep = np.cumsum(count + 1) - 1
    return out, sep, np.repeat(np.arange(n), count + 1), count


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    column = pa.array(texts, pa.string())
    words, sep, _, _ = shard_words(column)
    return [w[:-1] for w in np.split(words, sep[:-1] + 1)] if len(texts) else []


def blocks_of(benchmark: DataFrame, item: str, text: str, window: int, block_words: int, unnamed: bool = True) -> Iterator[Tests]:
    """The benchmark as blocks of bounded size, read one partition at a time."""
    ids, words, n = [], [], 0
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).distinct()
    rows = rows if unnamed else rows.where("i is not null")
    for row in rows.toLocalIterator():
        w = item_words([row.t])[0]
        if n + len(w) > block_words and ids:
            yield Tests(ids, words, window)
            ids, words, n = [], [], 0
        ids.append(row.i)
        words.append(w)
        n += len(w)
    yield Tests(ids, words, window)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, only_clean: bool = False, prefix: str = "", unnamed: bool = True) -> DataFrame:
    """Match every document against every benchmark item.

    Returns all columns of ``docs`` but the text, and: n_words, n_hit (words inside any matched window),
    n_items, items_sha256, contaminated, matches (longest verbatim matches: item_id, item_start, doc_start,
    n_words, in words). With ``only_clean``, the documents without a hit instead, with their own columns alone.

    Null and empty texts have no words and no hits. Items without words match nothing; repeated items count once.
    Items with a null id are searched for like others: all of them together count as one in n_items, and items_sha256
    leaves them out, as SQL's count of distinct rows and string_agg do. Without ``unnamed`` they match nothing. Repeated documents are each reported. A column of docs with the name of a
    new one gives way to it; ``prefix`` before the new names keeps both.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in blocks_of(benchmark, item, item_text, window, block_words, unnamed)]
    made_names = [f"{prefix}{x}" for x in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches")]
    kept = [f for f in docs.schema.fields if only_clean or f.name.lower() not in (text.lower(), *made_names)]
    match = "array<struct<item_id:string,item_start:int,doc_start:int,n_words:int>>"
    kinds = ("bigint", "bigint", "bigint", "string", "boolean", match)
    schema = StructType(kept if only_clean else [*kept, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in zip(made_names, kinds, strict=True))).fields])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, text):
            column = shard.column(shard.schema.get_field_index(text))
            words, sep, doc, count = shard_words(column)
            cover = np.zeros(len(words) + 1, np.int64)
            items: dict[int, set[str | None]] = {}
            runs: dict[int, list[tuple[str | None, int, int, int]]] = {}
            for b in blocks:
                tests = b.value
                if len(blocks) > 1:
                    vars(b).pop("_value", None)  # a worker holds one block at a time and reads the next from its disk
                f = Found(words, sep, tests)
                np.add.at(cover, f.place, 1)
                np.add.at(cover, f.place + f.need, -1)
                # consecutive windows on one diagonal of one item are one longest match
                which, offset = tests.item[f.test], tests.offset[f.test]
                order = np.lexsort((offset, f.place - offset, which))
                which, offset, place, need = which[order], offset[order], f.place[order], f.need[order]
                new = np.ones(len(place), bool)
                new[1:] = (which[1:] != which[:-1]) | (place[1:] - offset[1:] != place[:-1] - offset[:-1]) | (offset[1:] != offset[:-1] + 1)
                at = np.flatnonzero(new)
                last = np.append(at[1:], len(place))[: len(at)] - 1
                for a, z in zip(at.tolist(), last.tolist(), strict=True):
                    d = int(doc[place[a]])
                    items.setdefault(d, set()).add(tests.ids[which[a]])
                    begin = int(place[a]) - (int(sep[d - 1]) + 1 if d else 0)
                    runs.setdefault(d, []).append((tests.ids[which[a]], int(offset[a]), begin, int(place[z] + need[z] - place[a])))
            hit = np.cumsum(cover[:-1]) > 0
            n_hit = np.bincount(doc[hit], minlength=len(count))
            columns = {f: shard.column(shard.schema.get_field_index(f)) for f in names}
            if only_clean:
                yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(n_hit == 0))
                continue
            n = len(count)
            listed = [items.get(d, ()) for d in range(n)]
            made = [
                pa.array(count, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in listed], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(i for i in x if i is not None)).encode()).hexdigest() for x in listed], pa.string()),
                pa.array(n_hit > 0, pa.bool_()),
                pa.array([[dict(zip(("item_id", "item_start", "doc_start", "n_words"), m, strict=True)) for m in sorted(runs.get(d, ()), key=lambda m: (m[0] is not None, m[0] or "", m[1:]))] for d in range(n)], pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays([*columns.values(), *made], [*names, *made_names])

    return docs.mapInArrow(run, schema)


def remove_affected(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark window occurs, with their columns."""
    return scan(docs, benchmark, only_clean=True, **options)
