"""Content-addressed chunk store on plain Parquet: cut, deduplicate, write, read back, verify.

A *payload* is the byte string of a document. Gear hashes cut it into chunks where the content says so;
equal payloads are one payload class, and a chunk that several payloads hold is stored once, by the
payload with the smallest key. Only digests are shuffled to find out who stores what; bytes go from the
worker that cut them straight into the store.

Store rows: root, digests in order, own (the chunks that this payload stores: digest, compressed bytes).
``root`` is the Merkle root of the chunk digests. Reading back joins payloads to the chunks of others by
digest; a payload's own chunks lie in its row already. Hot chunks are salted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.llm.shared import keep, sized

WINDOW = 32
#: Gear values by rule: a seeded generator's draws, one table for each number of symbols.
_GEAR: dict[int, np.ndarray] = {}


def gear(symbols: int) -> np.ndarray:
    if symbols not in _GEAR:
        rng = np.random.Generator(np.random.PCG64(20240229 + symbols))
        _GEAR[symbols] = rng.integers(0, 1 << 32, symbols, dtype=np.uint32)
    return _GEAR[symbols]


def rolling(symbols: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Gear hash over the last 32 symbols at every position, by doubling the window."""
    h = table[symbols]
    width = 1
    while width < WINDOW and width < len(h):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def cuts(symbols: np.ndarray, offs: np.ndarray, table: np.ndarray, bits: int, least: int, most: int) -> list[list[int]]:
    """For each text its chunk ends, relative to its start. Chunks have ``least`` to ``most`` symbols but for the last."""
    h = rolling(symbols, table)
    marks = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    at = np.searchsorted(marks, offs)
    out = []
    for i in range(len(offs) - 1):
        begin, size = int(offs[i]), int(offs[i + 1] - offs[i])
        ends, last = [], 0
        if size > least:
            for mark in (marks[at[i] : at[i + 1]] - begin).tolist():
                while mark - last > most:
                    last += most
                    ends.append(last)
                if mark - last >= least and mark < size:
                    last = mark
                    ends.append(last)
            while size - last > most:
                last += most
                ends.append(last)
        if size > last or not ends:
            ends.append(size)
        out.append(ends)
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Root over leaf digests: pairs are hashed level by level, an odd one moves up."""
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def digest(piece: bytes) -> bytes:
    return hashlib.sha256(piece).digest()[:20]


def blobs(pieces: list[bytes], digests: list[bytes], z: zstandard.ZstdCompressor) -> list[dict]:
    """The distinct chunks of a payload, compressed."""
    return [{"digest": d, "blob": z.compress(p)} for d, p in dict(zip(digests, pieces, strict=True)).items()]


#: From so many payloads on a chunk counts as hot: its rows are spread over a task for each HOT payloads.
HOT = 200


class Store:
    """``recipes``: document rows as given, with root and digests. ``chunks``: payload rows. ``borrowed``: which payload needs which chunk of another."""

    def __init__(self, recipes: DataFrame, chunks: DataFrame, borrowed: DataFrame):
        self.recipes, self.chunks, self.borrowed = recipes, chunks, borrowed


def build(light: DataFrame, full: DataFrame, id_col: str) -> Store:
    """Write recipes and the unique chunks.

    ``light`` has id_col, root, digests (in order) and any columns about the document. ``full`` has id_col,
    root, digests and own (distinct chunks: digest, blob) of the same documents; they may be cut again for
    it. A null id is an id of its own; repeated rows and copies share one payload, written once.
    """
    recipes = keep(light, "recipes")
    payload = recipes.groupBy("root").agg(F.min(id_col).alias("keeper"), F.count("*").alias("copies"), F.first("digests").alias("digests"))
    refs = payload.select("root", F.explode(F.array_distinct("digests")).alias("digest"))
    owners = refs.groupBy("digest").agg(F.min("root").alias("owner"), F.count("*").alias("users")).where("users > 1")
    # a hot chunk's payloads are split between tasks as the join runs (adaptive skew join): digests and roots alone
    borrowed = keep(refs.join(owners, "digest").where("owner <> root").drop("owner"), "borrowed")
    lists = borrowed.groupBy("root").agg(F.collect_list("digest").alias("foreign"))
    # Only payloads with copies or borrowed chunks need a mark; all others are written by the one document that has them.
    marks = payload.select("root", "keeper", "copies").join(lists, "root", "left").where("copies > 1 or foreign is not null")
    marks = keep(marks, "marks")
    writers = full.join(sized(marks.withColumnRenamed("root", "m_root")), F.col("root") == F.col("m_root"), "left")
    writers = writers.where(F.col("copies").isNull() | F.col(id_col).eqNullSafe(F.col("keeper")))
    own = F.when(F.col("foreign").isNull(), F.col("own")).otherwise(F.filter("own", lambda c: ~F.array_contains(F.col("foreign"), c["digest"])))
    rows = writers.select("root", "digests", own.alias("own"), F.col("foreign").isNull().alias("complete"))
    twice = recipes.join(sized(marks.where("copies > 1").select("root", "keeper")), "root").where(F.col(id_col).eqNullSafe(F.col("keeper")))
    if not twice.groupBy("root").count().where("count > 1").isEmpty():  # the very same row occurs again
        rows = rows.dropDuplicates(["root"])
    return Store(recipes, keep(rows, "chunks", codec="uncompressed"), borrowed)


def payloads(store: Store) -> DataFrame:
    """Each stored payload once: root, digests in order, and all its chunks (digest, blob) gathered from the store."""
    chunks, borrowed = store.chunks, store.borrowed
    need = borrowed.select("digest", "users").distinct()
    lent = chunks.select(F.explode("own").alias("c")).select("c.digest", "c.blob").join(sized(need), "digest")
    # A hot chunk's row is copied once for each salt; the payloads that borrow it are spread over the salts.
    last = F.expr(f"users div {HOT}")
    lent = lent.select("digest", "blob", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("salt"))
    asks = borrowed.withColumn("salt", F.pmod(F.xxhash64("root"), last + 1))
    got = asks.join(lent, ["digest", "salt"]).groupBy("root").agg(F.collect_list(F.struct("digest", "blob")).alias("got"))
    whole = chunks.where("complete").select("root", "digests", "own")
    parts = chunks.where("not complete").join(got, "root").select("root", "digests", F.concat("own", "got").alias("own"))
    return whole.unionByName(parts)


def restore(digests: list[bytes], own: list[dict], root: bytes, z: zstandard.ZstdDecompressor) -> bytes:
    """The payload, after checks of every chunk and of the Merkle root."""
    pieces = {}
    for c in own:
        piece = z.decompress(c["blob"])
        if digest(piece) != c["digest"]:
            raise ValueError("a stored chunk does not match its digest")
        pieces[c["digest"]] = piece
    if merkle(digests) != root:
        raise ValueError("a recipe does not match its root")
    return b"".join(map(pieces.__getitem__, digests))
