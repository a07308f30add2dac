"""Media payloads in a content-addressed chunk store.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become the grey samples of an
8-bit PGM image 64 samples wide; the image file's bytes are what is stored. Rolling gear hashes cut them,
chunk digests are deduplicated by joins, and ordered chunk lists rebuild the file, which is checked chunk
by chunk and parsed again before any feature is computed.

Nulls count as empty texts (one row of zeros). Equal texts share one stored file. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.llm.blocks import column_bytes, shards
from octavo.llm.castore import blobs, build, cuts, digest, gear, merkle, payloads, restore

WIDTH = 64
#: Chunks of about 2 ** BITS bytes, between LEAST and MOST.
BITS, LEAST, MOST = 12, 1024, 16384


def to_pgm(data: bytes) -> bytes:
    rows = max(1, -(-len(data) // WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, rows) + data.ljust(rows * WIDTH, b"\0")


def from_pgm(stored: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a binary 8-bit PGM."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", stored)
    if head is None:
        raise ValueError("not an 8-bit PGM")
    width, height = int(head[1]), int(head[2])
    samples = stored[head.end() :]
    if len(samples) != width * height:
        raise ValueError("the image has not as many samples as its header says")
    return width, height, samples


def feature(width: int, height: int, samples: bytes) -> str:
    """Size, mean, deviation, an 8-bin histogram, and a 64-bit hash of which of 8 x 8 cells are above the mean."""
    x = np.frombuffer(samples, np.uint8)
    mean = x.mean()
    bins = np.bincount(x >> 5, minlength=8)
    column = x.reshape(height, 8, width // 8).sum(2, dtype=np.int64)
    edge = np.arange(9) * height // 8
    upto = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(column, 0)])
    area = np.maximum(1, np.diff(edge))[:, None] * (width // 8)
    cells = (upto[edge[1:]] - upto[edge[:-1]]) / area
    bits = int("".join("1" if c > mean else "0" for c in cells.ravel()), 2)
    return f"{width}x{height} mean={mean:.4f} sd={x.std():.4f} hist={'/'.join(map(str, bins.tolist()))} hash={bits:016x}"


def cut(docs: DataFrame, text: str, id_col: str, own: bool) -> DataFrame:
    """Per document: id, n_bytes, root and chunk digests in order; with ``own``, the distinct chunks and their bytes too."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, values = zstandard.ZstdCompressor(level=3), gear(256)
        for shard in shards(batches, text):
            raw, offs = column_bytes(shard.column(1))
            data = raw.tobytes()
            files = [to_pgm(data[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            at = np.append(0, np.cumsum([len(f) for f in files], dtype=np.int64))
            ends = cuts(np.frombuffer(b"".join(files), np.uint8), at, values, BITS, LEAST, MOST)
            roots, lists, owned = [], [], []
            for f, stops in zip(files, ends, strict=True):
                parts = [f[a:b] for a, b in zip([0, *stops], stops, strict=False)]
                digests = [digest(p) for p in parts]
                roots.append(merkle(digests))
                lists.append(digests)
                if own:
                    owned.append(blobs(parts, digests, z))
            made = [shard.column(0), pa.array(np.diff(offs)), pa.array(roots, pa.binary()), pa.array(lists, pa.list_(pa.binary()))]
            if own:
                made.append(pa.array(owned, pa.list_(pa.struct([("digest", pa.binary()), ("blob", pa.binary())]))))
            yield pa.RecordBatch.from_arrays(made, [id_col, "n_bytes", "root", "digests", *["own"] * own])

    schema = f"`{id_col}` {kind}, n_bytes bigint, root binary, digests array<binary>" + ", own array<struct<digest:binary,blob:binary>>" * own
    return docs.select(id_col, text).mapInArrow(run, schema)


def store(docs: DataFrame, text: str = "text", id_col: str = "doc_id"):
    """Write the recipes and unique chunks of all documents' media files. The texts are cut twice rather than shuffled or staged."""
    return build(cut(docs, text, id_col, own=False), cut(docs, text, id_col, own=True), id_col)


def features(stored, id_col: str = "doc_id", media: bool = False) -> DataFrame:
    """Per document, from the stored bytes: sizes, digests, feature; with ``media`` the file itself too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for r, d, o in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                f = restore(d, o, r, z)
                width, height, samples = from_pgm(f)
                out.append((r, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature(width, height, samples), *[f] * media))
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * media]
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["root", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * media]
    schema = "root binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary" * media
    found = payloads(stored).select("root", "digests", "own").mapInArrow(run, schema)
    return stored.recipes.select(id_col, "n_bytes", "root").join(found, "root").select(id_col, "n_bytes", *(F.col(n) for n in names[1:]))
