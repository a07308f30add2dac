"""Array-at-a-time text work over Arrow string columns: spans of words, hashes, shards.

A column's UTF-8 bytes are read in place from its Arrow buffer, so that no Python string is made
for a word. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U8 = np.uint64
_M1, _M2, _LEN = U8(0xFF51AFD7ED558CCD), U8(0xC4CEB9FE1A85EC53), U8(0x9E3779B97F4A7C15)
_KEEP = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)
PAD = 16


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U8(32))
    h = h * _M1
    h ^= h >> U8(29)
    h *= _M2
    return h ^ (h >> U8(32))


def table(word_bytes, lower: bool = False) -> np.ndarray:
    """Byte map: bytes outside ``word_bytes`` to 0, and A-Z to a-z if asked."""
    out = np.zeros(256, np.uint8)
    for b in word_bytes:
        out[b] = b + 32 if lower and 65 <= b <= 90 else b
    return out


#: Letters of any script (every byte of a multi-byte character counts), no digits.
LETTERS = table([*range(65, 91), *range(97, 123), *range(128, 256)], lower=True)
#: Lower-cased ASCII letters and digits and every non-ASCII byte.
ALNUM = table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)], lower=True)
#: Everything but the space and the control characters 9 to 13. Byte 0 is a word byte here and is mapped to 255.
NONSPACE = table([b for b in range(1, 256) if b != 32 and not 9 <= b <= 13], lower=True)
NONSPACE[0] = 255


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


#: Bytes of text worked on at a time.
SHARD = 3 << 20


def release() -> None:
    """Give freed memory back to the system: workers live long and share an executor's allowance with the JVM."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        found = ctypes.CDLL("libc.so.6")
        return found if hasattr(found, "malloc_trim") else None
    except OSError:  # another C library: nothing to trim
        return None


_LIBC = _libc()


def shards(batches: Iterator[pa.RecordBatch], text: str, limit: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that a shard's texts stay near ``limit`` bytes; a row is never cut."""
    for batch in batches:
        _, offs = column_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
            release()


def word_spans(raw: np.ndarray, offs: np.ndarray, bytemap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mapped and padded bytes, and starts, ends and document numbers of the words, which never cross texts."""
    m = np.zeros(len(raw) + PAD, np.uint8)
    np.take(bytemap, raw, out=m[: len(raw)])
    n = len(raw)
    w = m[:n] != 0
    before = np.zeros(n, bool)
    before[1:] = w[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = w[1:]
    last = offs[1:][offs[1:] > 0] - 1
    after[last] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return m, starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hash(m: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; ``m`` is padded by PAD bytes. Spans of up to 8 bytes and equal length can't collide."""
    lanes = np.ndarray((max(0, len(m) - 7),), "<u8", m, strides=(1,))
    length = ends - starts
    h = mix(length.astype(U8) * _LEN)
    if not len(starts):
        return h
    h = mix(h ^ (lanes[starts] & _KEEP[np.minimum(length, 8)]))
    rest, at = np.flatnonzero(length > 8), 8
    while rest.size:
        lane = lanes[starts[rest] + at] & _KEEP[np.minimum(length[rest] - at, 8)]
        h[rest] = mix((h[rest] + _LEN) ^ lane)
        at += 8
        rest = rest[length[rest] > at]
    return h


def per_doc(docs: np.ndarray, n: int) -> np.ndarray:
    """Offsets (n + 1) of the words of each document, from sorted document numbers."""
    return np.searchsorted(docs, np.arange(n + 1))


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows begin a new combination of keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def gather_ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


def binary_list(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
