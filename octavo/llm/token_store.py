"""Token ids in a content-addressed store.

Documents are encoded whole; the id stream of each, closed by an end id, is cut by rolling hashes over
ids, unique chunks are stored once, recipes and Merkle roots verify what is read back.

Format: a payload is the ids as little-endian unsigned integers, of 2 bytes if the vocabulary (with the
end id) has at most 65,536 ids, else 4. Recipes lie in ascending order of the document id, each with the
number ``part`` of its file and its ids' count; ``manifest`` has for each part its documents, ids and the
Merkle-style root over the recipes' roots in order.

A text's added tokens (such as <|endoftext|>) have their own ids, as in the tokenizer's encoding of the whole text
by its defaults; without ``special`` they are encoded as any other text.

Nulls and empty texts give the end id alone. Null document ids come first. Repeated rows each have a
recipe, and share one payload. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octavo.llm.blocks import PAD, column_bytes, gather_ragged, shards, span_hash
from octavo.llm.castore import Store, blobs, build, cuts, digest, gear, merkle, payloads, restore
from octavo.llm.shared import keep, sized

END_ID = 2
#: Chunks of about 2 ** BITS ids, between LEAST and MOST.
BITS, LEAST, MOST = 9, 128, 4096
#: Distinct text pieces whose ids a worker remembers; beyond that it starts anew.
REMEMBERED, LATEST = 1_000_000, 50_000
#: New pieces given to the tokenizer at a time.
AT_ONCE = 4096
#: Bytes of text encoded at a time.
SHARD = 1 << 20

_SAFE = np.zeros(256, bool)
_SAFE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = _SAFE & ~_LETTER
_SIGN[48:58] = False


def pieces(raw: np.ndarray, offs: np.ndarray, added: Iterable[tuple[bytes, bool]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces that a byte-level pre-tokenizer treats independently. They cover all bytes in order.

    Such a tokenizer takes runs of letters, of digits, of other signs (each with one space before it) and of
    white space. So a new token always begins
    - at a single space between two characters that aren't white space; only spaces between visible ASCII
      characters or letters of two bytes (first byte 0xC3) are used, beside which no Unicode white space is,
    - where a sign or a line feed follows an ASCII letter, or a line feed a sign,
    - where an ASCII letter follows a single line feed (of several, the last is a token of its own).

    Added tokens are not cut; where their second value is true, what is beside them counts too, and their whole
    text is one piece.
    """
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        space = np.flatnonzero(raw[1:-1] == 0x20) + 1
        before, after = raw[space - 1], raw[space + 1]
        ok = _SAFE[before] | ((before >= 0x80) & (space > 1) & (raw[space - 2] == 0xC3))
        ok &= _SAFE[after] | (after == 0xC3)
        cut[space[ok]] = True
        letter, sign, feed = _LETTER[raw], _SIGN[raw], raw == 10
        cut[1:n] |= letter[:-1] & (sign[1:] | feed[1:]) | sign[:-1] & feed[1:]
        cut[2:n] |= (letter[:-2] | sign[:-2]) & feed[1:-1] & letter[2:]
    data = raw.tobytes() if added else b""
    for token, beside in added:
        a = data.find(token)
        while a >= 0:
            k = int(np.searchsorted(offs, a, side="right"))
            cut[offs[k - 1] + 1 if beside else a + 1 : offs[k] if beside else a + len(token)] = False
            a = data.find(token, a + 1)
    cut[offs[:-1]] = True
    starts = np.flatnonzero(cut[:n])
    return starts, np.append(starts[1:], n)


class Growing:
    """A flat array that values are added to; its room doubles, so that adding does not copy all of it each time."""

    def __init__(self, first: np.ndarray):
        self.room, self.n = first, len(first)

    def __len__(self) -> int:
        return self.n

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            room = np.empty(max(2 * len(self.room), self.n + len(more)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[at]


class Encoder:
    """Encodes columns of texts; ids of pieces seen before are looked up by hash.

    What is remembered is held in flat arrays, some 30 bytes a piece: a sorted one, and a small dict of
    the latest pieces that is merged into it now and then.
    """

    def __init__(self, path: str, end_id: int, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        known = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [(t.content.encode(), t.lstrip or t.rstrip or t.single_word) for t in known if special or not t.special]
        self.end_id = end_id
        self.kind = np.uint16 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.latest: dict[int, int] = {}
        self.pool = Growing(np.array([self.end_id], self.kind))
        self.start, self.length = Growing(np.zeros(1, np.int64)), Growing(np.ones(1, np.int32))

    def merge(self) -> None:
        h = np.concatenate([self.hashes, np.fromiter(self.latest.keys(), np.uint64, len(self.latest))])
        order = np.argsort(h, kind="stable")
        self.slots = np.concatenate([self.slots, np.fromiter(self.latest.values(), np.int32, len(self.latest))])[order]
        self.hashes, self.latest = h[order], {}

    def slots_of(self, unique: np.ndarray, text) -> np.ndarray:
        """The slot of each piece; ``text(k)`` gives the texts of new ones."""
        if len(self.start) + len(unique) > max(REMEMBERED, 2 * len(unique)):
            self.clear()
        elif len(self.latest) > LATEST:
            self.merge()
        slot = np.full(len(unique), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, unique), len(self.hashes) - 1)
            slot = np.where(self.hashes[at] == unique, self.slots[at], -1).astype(np.int64)
        miss = np.flatnonzero(slot < 0)
        hashes = unique[miss].tolist()
        slot[miss] = [self.latest.get(h, -1) for h in hashes]
        fresh = slot[miss] < 0
        new = miss[fresh]
        if len(new):
            lengths, flats = [], []
            for k in range(0, len(new), AT_ONCE):  # an encoding's object is large beside its ids
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(text(new[k : k + AT_ONCE]), add_special_tokens=False)]
                lengths.append(np.fromiter(map(len, ids), np.int32, len(ids)))
                flats.append(np.fromiter(chain.from_iterable(ids), self.kind, int(lengths[-1].sum())))
            length, base = np.concatenate(lengths), len(self.start)
            self.start.add(len(self.pool) + np.cumsum(length, dtype=np.int64) - length)
            self.length.add(length)
            for flat in flats:
                self.pool.add(flat)
            slot[new] = np.arange(base, base + len(new))
            self.latest.update(zip(unique[new].tolist(), range(base, base + len(new)), strict=True))
        return slot

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's ids, with the end id at each text's end."""
        raw, offs = column_bytes(column)
        n = len(offs) - 1
        starts, ends = pieces(raw, offs, self.added)
        padded = np.zeros(len(raw) + PAD, np.uint8)
        padded[: len(raw)] = raw
        codes, unique = pd.factorize(span_hash(padded, starts, ends))
        first = np.zeros(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]

        data = memoryview(raw)

        def text(k: np.ndarray) -> list[str]:
            return [str(data[a:z], "utf-8") for a, z in zip(starts[first[k]].tolist(), ends[first[k]].tolist(), strict=True)]

        slot = self.slots_of(unique, text)
        doc = np.searchsorted(offs, starts, side="right") - 1
        count = np.bincount(doc, minlength=n)
        order = np.zeros(len(codes) + n, np.int64)  # slot 0 is the end id
        order[np.arange(len(codes)) + doc] = slot[codes] if len(codes) else 0
        length = self.length[order]
        ids = self.pool[gather_ragged(self.start[order], length)]
        total = np.append(0, np.cumsum(length, dtype=np.int64))
        return ids, np.append(0, total[np.cumsum(count + 1)])


_ENCODERS: dict[tuple[str, int, bool], Encoder] = {}


def encoder(path: str, end_id: int, special: bool = True) -> Encoder:
    """One for each worker process: what a task has encoded serves the next."""
    key = (path, end_id, special)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def encoded(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", end_id: int = END_ID, special: bool = True) -> DataFrame:
    """Per document: id, n_tokens, root, digests of its chunks in order, and own: its distinct chunks with their bytes."""
    width = 2 if max(vocabulary(tokenizer), end_id + 1) <= 1 << 16 else 4
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, z, values = encoder(tokenizer, end_id, special), zstandard.ZstdCompressor(level=3), gear(1 << 16)
        for shard in shards(batches, text, SHARD):
            ids, offs = tokens.encode(shard.column(1))
            ends = cuts(ids & 0xFFFF, offs, values, BITS, LEAST, MOST)
            data = memoryview(ids.astype(f"<u{width}").tobytes())
            roots, lists, owned = [], [], []
            for begin, stops in zip(offs[:-1].tolist(), ends, strict=True):
                parts = [bytes(data[(begin + a) * width : (begin + b) * width]) for a, b in zip([0, *stops], stops, strict=False)]
                digests = [digest(p) for p in parts]
                roots.append(merkle(digests))
                lists.append(digests)
                owned.append(blobs(parts, digests, z))
            yield pa.RecordBatch.from_arrays(
                [shard.column(0), pa.array(np.diff(offs)), pa.array(roots, pa.binary()), pa.array(lists, pa.list_(pa.binary())), pa.array(owned, pa.list_(pa.struct([("digest", pa.binary()), ("blob", pa.binary())])))],
                [id_col, "n_tokens", "root", "digests", "own"],
            )

    schema = f"`{id_col}` {kind}, n_tokens bigint, root binary, digests array<binary>, own array<struct<digest:binary,blob:binary>>"
    return docs.select(id_col, text).mapInArrow(run, schema)


class TokenStore:
    def __init__(self, store: Store, manifest: DataFrame, id_col: str, width: int):
        self.store, self.manifest, self.id_col, self.width = store, manifest, id_col, width


def part_roots(recipes: DataFrame, id_col: str) -> DataFrame:
    row = F.sort_array(F.collect_list(F.struct(F.col(id_col), "root")))
    return recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.array_join(F.transform(row, lambda r: F.hex(r["root"])), ","), 256).alias("part_root"))


def write(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", end_id: int = END_ID, special: bool = True) -> TokenStore:
    """Encode once into the shared folder, then recipes in document order, unique chunks and the manifest."""
    staged = keep(encoded(docs, tokenizer, text, id_col, end_id, special), "encoded", codec="uncompressed")
    light = staged.drop("own").repartitionByRange(F.col(id_col).asc_nulls_first(), F.col("root"))
    light = light.sortWithinPartitions(F.col(id_col).asc_nulls_first(), "root").withColumn("part", F.spark_partition_id())
    store = build(light, staged, id_col)
    width = 2 if max(vocabulary(tokenizer), end_id + 1) <= 1 << 16 else 4
    return TokenStore(store, keep(part_roots(store.recipes, id_col), "manifest"), id_col, width)


def starts(recipes: DataFrame, id_col: str) -> DataFrame:
    """The ids before each document: sums over the parts, then within a part. Parts are as many as recipe files."""
    parts = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    w = Window.partitionBy("part").orderBy(F.col(id_col).asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, -1)
    out = recipes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    return out.join(sized(before), "part").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")


def read(tokens: TokenStore, ids: bool = False) -> DataFrame:
    """From the files: per document id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers), and ids if asked.

    Every chunk and root is verified on the way; a part whose recipes do not match the manifest is an error.
    """
    width, id_col = tokens.width, tokens.id_col
    kept = ", ids array<int>" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = [np.frombuffer(restore(d, o, r, z), f"<u{width}").astype("<u4") for r, d, o in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            made = [batch.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in rows], pa.int64())]
            if ids:
                made.append(pa.array([x.astype(np.int32) for x in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(made, ["root", "n_read", "ids_crc32", *["ids"] * ids])

    found = payloads(tokens.store).select("root", "digests", "own").mapInArrow(run, f"root binary, n_read bigint, ids_crc32 bigint{kept}")
    recipes = starts(tokens.store.recipes.select(id_col, "n_tokens", "root", "part"), id_col)
    told = part_roots(tokens.store.recipes, id_col).select("part", F.col("part_root").alias("now"))
    same = tokens.manifest.join(told, "part", "left").select("part", F.when(F.col("now") == F.col("part_root"), F.lit(True)).otherwise(F.raise_error(F.lit("a manifest does not match its recipes"))).alias("verified"))
    out = recipes.join(sized(same), "part").join(found, "root")
    # The counts of recipes decide where documents start, so they must be those of the ids read.
    n = F.when(F.col("n_read") == F.col("n_tokens"), F.col("n_read")).otherwise(F.raise_error(F.lit("a recipe's count is not that of its ids")))
    return out.where("verified").select(id_col, "start", n.alias("n_tokens"), "ids_crc32", *["ids"] * ids)
