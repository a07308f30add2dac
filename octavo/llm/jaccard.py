"""Near-duplicate join on word n-grams by MinHash banding with exact verification.

1. Texts with one and the same n-gram set form a text class (c, a 64-bit hash of the set); copies are joined
   by it and take no further part. Each class has BANDS x ROWS MinHash values. Two sets of similarity s share
   a band with probability 1 - (1 - s ** ROWS) ** BANDS; rows and bands are chosen for the recall asked for at
   the threshold (see ``banding``).
2. Band hashes are shuffled, what one task reads of a large bucket as one row. Buckets of more than SMALL classes
   give one edge per member, to the smallest; these are contracted first. In the other buckets, pairs that lie
   in different components are kept if the MinHash bytes of the two agree often enough (seven standard
   deviations below the threshold). Components of all these edges are clusters: no pair that shares a band
   and may reach the threshold is apart.
3. The n-gram sets of clustered texts are brought together once per cluster, in blocks by set size where a
   cluster is large; all pairs of sets whose sizes allow it are counted there as matrix products, so hot
   groups neither emit pairs nor meet in one task. Only counts of links and a spanning forest leave a block.
4. Components of the exact links are the classes reported.

Texts of fewer words than the n-gram have all their words as the one n-gram; texts without words have
no links and are classes of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from octavo.llm.blocks import ALNUM, U8, column_bytes, mix, per_doc, run_starts, shards, span_hash, word_spans
from octavo.llm.components import components
from octavo.llm.interpolation import deflate, inflate
from octavo.llm.shared import BROADCAST_ROWS, keep, scratch, sized, unused

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9995
ROWS = 8
#: Classes in a bucket up to which pairs are made; larger buckets are joined through their smallest member.
SMALL = 32
#: Texts whose band hashes are sorted at once in a worker before they are shuffled.
CLASSES = 1 << 14
#: Pairs of one class from which its sketch is sent to all tasks instead of its pairs to one.
HUB = 500
#: Classes and n-grams of a block in which all pairs are counted at once.
BLOCK, BLOCK_GRAMS = 1200, 2_000_000
_A = U8(0x9E3779B97F4A7C15)


def banding(threshold: float, recall: float, rows: int = ROWS) -> int:
    """The least number of bands at which a pair at the threshold shares one with the recall asked for."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct n-gram hashes, sorted within each text, and their offsets."""
    raw, offs = column_bytes(column)
    m, starts, ends, doc = word_spans(raw, offs, ALNUM)
    h = span_hash(m, starts, ends)
    n = len(offs) - 1
    at = per_doc(doc, n)
    full = max(0, len(h) - words + 1)
    g = h[:full].copy()
    for k in range(1, words):
        g = mix(g * _A + h[k : k + full])
    out, size = [], np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - a >= words:
            s = np.sort(g[a : b - words + 1])
            s = s[np.append(True, s[1:] != s[:-1])]
        elif b > a:
            s = h[a : a + 1].copy()
            for k in range(a + 1, b):
                s = mix(s * _A + h[k : k + 1])
            s = mix(s + U8(b - a))
        else:
            continue
        out.append(s)
        size[i] = len(s)
    return np.concatenate(out) if out else np.zeros(0, U8), np.append(0, np.cumsum(size))


def set_hash(grams: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set (0 for empty ones)."""
    out = np.zeros(len(offs) - 1, U8)
    some = np.flatnonzero(np.diff(offs))
    if len(some):
        out[some] = mix(np.add.reduceat(mix(grams ^ _A), offs[some]) + mix(np.diff(offs)[some].astype(U8)))
    return out


def signatures(grams: np.ndarray, offs: np.ndarray, count: int, chunk: int = 1 << 15) -> np.ndarray:
    """(texts, count) MinHash values; empty sets have the largest value."""
    rng = np.random.Generator(np.random.PCG64(5))
    a, b = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)
    n = len(offs) - 1
    out = np.full((count, n), 0xFFFFFFFF, np.uint32)
    x = (grams >> U8(32)).astype(np.uint32)
    some = np.flatnonzero(np.diff(offs))
    i = 0
    while i < len(some):
        j = i + 1
        while j < len(some) and offs[some[j] + 1] - offs[some[i]] <= chunk:
            j += 1
        lo, hi = int(offs[some[i]]), int(offs[some[j - 1] + 1])
        part, starts, own = x[lo:hi], offs[some[i:j]] - lo, some[i:j]
        v = np.empty(hi - lo, np.uint32)
        for k in range(count):
            np.multiply(part, a[k], out=v)
            np.add(v, b[k], out=v)
            out[k, own] = np.minimum.reduceat(v, starts)
        i = j
    return np.ascontiguousarray(out.T)


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) 64-bit hashes of each band, its number included."""
    n, count = sig.shape
    lanes = sig.reshape(n, count // rows, rows).astype(U8)
    h = np.broadcast_to(mix(np.arange(1, count // rows + 1, dtype=U8) * _A), lanes.shape[:2]).copy()
    for k in range(rows):
        h = mix(h * _A + lanes[:, :, k])
    return h


def sketched(docs: DataFrame, text: str, id_col: str, words: int, bands: int) -> DataFrame:
    """Per document: id, c (null without words), n, band hashes, and the lowest byte of every MinHash value."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, text):
            grams, offs = gram_sets(shard.column(1), words)
            c, n = set_hash(grams, offs), np.diff(offs)
            sig = signatures(grams, offs, bands * ROWS)
            flat = pa.array(band_hashes(sig, ROWS).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), flat)
            low = (sig & np.uint32(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([shard.column(0), pa.array(c.view(np.int64), mask=n == 0), pa.array(n), lists, pa.array([r.tobytes() for r in low], pa.binary())], [id_col, "c", "n", "bands", "sig"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, c bigint, n bigint, bands array<bigint>, sig binary")


def dealt(light: DataFrame) -> DataFrame:
    """Rows (h, c, n) for the shuffle on band hashes, repeated classes and large buckets reduced where they are read.

    n >= 1: class c is in bucket h and stands for n of its classes, which are linked to it by rows with n = 0:
    an edge (h, c) between classes, keyed by the larger one. So a bucket sends at most SMALL rows for each
    ``CLASSES`` texts read, whatever share of all classes it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            c, h = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            c, one = np.unique(c, return_index=True)
            h, c = h[one].ravel(), np.repeat(c, h.shape[1])
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            at = run_starts(h)
            size = np.diff(np.append(at, len(h)))
            first = np.repeat(at, size)
            large = np.repeat(size > SMALL, size)
            edge = large & (first != np.arange(len(h)))
            n = np.where(edge, 0, np.where(large, np.repeat(size, size), 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.where(edge, c, h)), pa.array(np.where(edge, c[first], c)), pa.array(n)], ["h", "c", "n"])

        held, rows = [], 0
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(zero_copy_only=False), flat.reshape(batch.num_rows, -1)))
                rows += batch.num_rows
            if rows >= CLASSES:
                yield flush()
                rows = 0
        if held:
            yield flush()

    return light.where("c is not null").select("c", "bands").mapInArrow(run, "h bigint, c bigint, n int")


def buckets(rows: DataFrame) -> DataFrame:
    """Edges (a, b) of the buckets of two classes or more, a the bucket's smallest class; h and size only if size is at most SMALL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            given = n == 0
            x, y = h[given], c[given]
            h, c, n = h[~given], c[~given], n[~given]
            order = np.lexsort((c, h))
            h, c, n = h[order], c[order], n[order]
            at = run_starts(h, c)  # a class that several tasks read
            n = np.maximum.reduceat(n, at) if len(at) else n
            h, c = h[at], c[at]
            at = run_starts(h)
            size = np.diff(np.append(at, len(h)))
            many = np.add.reduceat(n, at) > SMALL if len(at) else np.zeros(0, bool)
            first = np.repeat(at, size)
            rest = first != np.arange(len(h))
            small = np.repeat(~many, size)[rest]
            h, a, b, size = h[rest], c[first][rest], c[rest], np.repeat(size, size)[rest]
            key = pa.array(np.concatenate([h, x]), mask=np.concatenate([~small, np.ones(len(x), bool)]))
            return pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([a, y])), pa.array(np.concatenate([b, x])), pa.array(np.concatenate([size, np.zeros(len(x), np.int64)]).astype(np.int32))], ["h", "a", "b", "size"])

        last: list[np.ndarray] = []  # the rows of the bucket that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if last:
                now = [np.concatenate(x) for x in zip(last, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            last = [x[cut:] for x in now]
            if cut:
                yield edges(*(x[:cut] for x in now))
        if last:
            yield edges(*last)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h bigint, a bigint, b bigint, size int")


def near(pairs: DataFrame, sigs: DataFrame, threshold: float, count: int) -> DataFrame:
    """(a, b, ok): whether sizes and MinHash bytes leave it possible that the pair reaches the threshold."""
    left = sigs.select(F.col("c").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    hubs = keep(pairs.groupBy("a").agg(F.count("*").alias("pairs")).where(F.col("pairs") >= HUB).select("a"), "hubs")
    n = hubs.count()
    if n:  # at most a HUB-th of the pairs' number: their rows are spread by the other side
        hot = pairs.join(sized(hubs, n), "a", "left_semi").join(sized(left.join(sized(hubs, n), "a", "left_semi"), n, HUB * 100), "a")
        both = pairs.join(sized(hubs, n), "a", "left_anti").join(left, "a").unionByName(hot)
    else:
        both = pairs.join(left, "a")
    both = both.join(sigs.select(F.col("c").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")
    least = count * threshold - 7 * math.sqrt(count * threshold * (1 - threshold))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(column_bytes(batch.column(i))[0], np.uint8).reshape(batch.num_rows, count) for i in (2, 3))
                ok = ((x == y).sum(1) >= least) & batch.column(4).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["a", "b", "ok"])

    fits = F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    return both.select("a", "b", "sa", "sb", fits.alias("fits")).mapInArrow(agree, "a bigint, b bigint, ok boolean")


def candidates(light: DataFrame, threshold: float, bands: int) -> DataFrame:
    """Edges (a, b) between classes, whose components hold every pair of classes that shares a band and may be similar.

    Buckets of more than SMALL classes are joined through their smallest class and contracted first. Of the others
    only what lies in different components of those is looked at: the pairs with the bucket's smallest class, and
    all pairs of a bucket in which one of these is no candidate. So a class has some edges, not one for each band
    and partner.
    """
    made = keep(buckets(dealt(light)), "buckets", codec="uncompressed")
    large = keep(components(made.where("h is null")), "large")
    label = lambda name: large.select(F.col("id").alias(f"id_{name}"), F.col("label").alias(f"label_{name}"))
    n_large = large.count()

    def apart(pairs: DataFrame) -> DataFrame:
        out = pairs.distinct()
        for x in ("a", "b"):
            out = out.join(sized(label(x), n_large), F.col(x) == F.col(f"id_{x}"), "left").withColumn(f"label_{x}", F.coalesce(f"label_{x}", x))
        return out.where("label_a <> label_b").select("a", "b")

    small = made.where("h is not null")
    first = keep(apart(small.select("a", "b")), "pairs")
    named = keep(small.select("a").unionByName(small.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "c"), "named")
    n = named.count()
    sigs = light.select("c", "sig", "n").where("c is not null")
    # a class may have any number of documents: one of each comes to a join, unless it needs no shuffle
    sigs = sigs.join(sized(named, n), "c", "left_semi").dropDuplicates(["c"]) if n <= BROADCAST_ROWS else sigs.dropDuplicates(["c"]).join(named, "c", "left_semi")
    sigs = keep(sigs, "sigs", codec="uncompressed")
    count = bands * ROWS
    checked = keep(near(first, sigs, threshold, count), "near")
    # buckets of three or more in which a class has not shown to be near the smallest one
    broken = small.where("size > 2").join(checked.where("not ok").select("a", "b"), ["a", "b"], "left_semi").select("h").distinct()
    members = small.join(broken, "h", "left_semi").groupBy("h").agg(F.sort_array(F.collect_list("b")).alias("all"))  # SMALL - 1 at most
    pairs = members.select("all", F.posexplode("all").alias("i", "a")).select("a", F.explode(F.slice("all", F.col("i") + 2, SMALL)).alias("b"))
    second = near(keep(apart(pairs), "pairs"), sigs, threshold, count).where("ok")
    stars = large.where("id <> label").select(F.col("label").alias("a"), F.col("id").alias("b"))
    return stars.unionByName(checked.where("ok").select("a", "b")).unionByName(second.select("a", "b"))


def matched(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs (left row, right row) with at least the threshold's similarity; never a set with itself."""
    size = np.array([len(s) for s in sets], np.float32)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    gram = np.cumsum(new) - 1
    df = np.bincount(gram)
    keep_ = df[gram] > 1
    code = np.cumsum(df > 1) - 1
    owner, gram = owner[keep_], code[gram[keep_]]
    common = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    step = max(256, (4 << 20) // max(1, len(sets)))
    edge = np.searchsorted(gram, np.arange(0, (int(gram[-1]) if len(gram) else 0) + 1 + step, step))
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if z > a:
            width = int(gram[z - 1] - gram[a]) + 1
            x = np.zeros((len(left), width), np.float32)
            y = np.zeros((len(right), width), np.float32)
            o, g = owner[a:z], gram[a:z] - gram[a]
            in_l, in_r = place_l[o] >= 0, place_r[o] >= 0
            x[place_l[o[in_l]], g[in_l]] = 1
            y[place_r[o[in_r]], g[in_r]] = 1
            common += x @ y.T
    union = size[left][:, None] + size[right][None, :] - common
    return (common >= np.float64(threshold) * union - 1e-6) & (left[:, None] != right[None, :])


def forest(linked: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component, in a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked))
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def counted(rows: DataFrame, threshold: float) -> DataFrame:
    """Per class and block: links to other classes, to their documents, and the least class of its component in the block.

    rows: task (group key), cluster, side (0: both sides, 1 or 2: one side of a pair of blocks), c, n, copies, grams.
    """

    def run(table: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        cluster, side, c, n, copies = (table.column(k).to_numpy() for k in ("cluster", "side", "c", "n", "copies"))
        blob = table.column("grams")
        order = np.lexsort((c, cluster))
        out = []
        cut = np.flatnonzero(np.append(True, cluster[order][1:] != cluster[order][:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
            own = order[a:b]
            sets = [np.cumsum(inflate(blob[int(i)].as_py(), "<u8", int(n[i]), z), dtype=U8) for i in own]
            here = np.arange(len(own))
            left = here if (side[own] == 0).all() else here[side[own] == 1]
            right = here if (side[own] == 0).all() else here[side[own] == 2]
            links = matched(sets, left, right, threshold)
            whole = np.zeros((len(own), len(own)), bool)
            whole[np.ix_(left, right)] = links
            whole |= whole.T
            label = forest(whole)
            out.append((c[own], whole.sum(1), whole @ copies[own], c[own][label]))
        columns = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]
        return pa.table(dict(zip(("c", "links", "doc_links", "least"), map(pa.array, columns), strict=True)))

    return rows.groupBy("task").applyInArrow(run, "c bigint, links bigint, doc_links bigint, least bigint")


def block_rows(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows for ``counted``: of small clusters (many in a task) and of pairs of blocks of large ones.

    Blocks of a large cluster are ranges of set sizes by powers of 1 / threshold (similar sets lie in one range or
    two adjacent ones), split by a hash. members: cluster, c, n, copies.
    """
    base = max(1.01, 1 / threshold * (1 + 1e-9))  # a little more, so that rounding puts no similar pair two ranges apart
    size = members.groupBy("cluster").agg(F.count("*").alias("classes"), F.sum("n").alias("grams_n"))
    large = size.where((F.col("classes") > BLOCK) | (F.col("grams_n") > BLOCK_GRAMS)).select("cluster")
    m = members.join(sets, "c")
    total = size.agg(F.sum("grams_n")).first()[0] or 0
    tasks = max(1, int(total) // (BLOCK_GRAMS // 4))
    few = m.join(sized(large), "cluster", "left_anti").withColumn("task", F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(tasks)).cast("string"))).withColumn("side", F.lit(0))
    many = members.join(sized(large), "cluster", "left_semi").withColumn("r", F.floor(F.log(F.col("n").cast("double")) / math.log(base)).cast("int"))
    ranges = many.groupBy("cluster", "r").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("k"))
    ranges = keep(ranges, "ranges")
    blocks = ranges.select("cluster", "r", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s"))
    other = blocks.select(F.col("cluster").alias("oc"), F.col("r").alias("o_r"), F.col("s").alias("os"))
    # each block with itself, later ones of its range, and those of the next range
    near = (F.col("o_r") == F.col("r")) & (F.col("os") >= F.col("s")) | (F.col("o_r") == F.col("r") + 1)
    pairs = blocks.join(other, (F.col("cluster") == F.col("oc")) & near).withColumn("task", F.concat_ws(":", F.lit("l"), "cluster", "r", "s", "o_r", "os"))
    same = (F.col("r") == F.col("o_r")) & (F.col("s") == F.col("os"))
    first = pairs.select("cluster", "r", "s", "task", F.when(same, 0).otherwise(1).alias("side"))
    second = pairs.where(~same).select("cluster", F.col("o_r").alias("r"), F.col("os").alias("s"), "task", F.lit(2).alias("side"))
    placed = many.join(sized(ranges), ["cluster", "r"]).withColumn("s", F.pmod(F.xxhash64("c"), F.col("k")).cast("int")).drop("k")
    dealt = placed.join(sized(first.unionByName(second)), ["cluster", "r", "s"]).join(sets, "c")
    columns = ["task", "cluster", "side", "c", "n", "copies", "grams"]
    return few.select(*columns), dealt.select(*columns)


def classified(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``join``, with c (the text class, null without words) and class_c: the text class of its class that is kept."""
    bands = banding(threshold, recall)
    light = keep(sketched(docs, text, id_col, words, bands), "sketched")
    with scratch(docs.sparkSession):  # what only the search for candidates reads
        edges = keep(candidates(light, threshold, bands), "candidates")
        clusters = keep(components(edges).select(F.col("id").alias("c"), F.col("label").alias("cluster")), "clusters", outer=True)
    texts = light.where("c is not null").groupBy("c").agg(F.min(id_col).alias("text_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    members = keep(clusters.join(texts, "c"), "clustered")
    # the n-gram sets of clustered texts, from one document of each
    chosen = members.select(F.col("text_id").alias("_rep")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for shard in shards(batches, text):
            grams, offs = gram_sets(shard.column(0), words)
            blobs = [deflate(np.diff(grams[a:b], prepend=U8(0)), z) if b > a else None for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(set_hash(grams, offs).view(np.int64)), pa.array(blobs, pa.binary())], ["c", "grams"])

    own = docs.select(F.col(id_col).alias("_id"), F.col(text).alias(text)).join(sized(chosen), F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select(text)
    sets = keep(own.mapInArrow(run, "c bigint, grams binary").where("grams is not null").dropDuplicates(["c"]), "sets", codec="uncompressed")
    few, many = block_rows(members.select("cluster", "c", "n", "copies"), sets, threshold)
    small = keep(counted(few, threshold), "links")
    large = keep(counted(many, threshold), "links")
    again = components(large.where("c <> least").select(F.col("c").alias("a"), F.col("least").alias("b")))
    sums = large.groupBy("c").agg(F.sum("links").alias("links"), F.sum("doc_links").alias("doc_links"))
    sums = sums.join(again.withColumnRenamed("id", "c"), "c", "left").select("c", "links", "doc_links", F.coalesce("label", "c").alias("least"))
    links = small.unionByName(sums)
    joined = texts.join(sized(keep(links, "links")), "c", "left").withColumn("least", F.coalesce("least", "c"))
    first = F.min(F.struct(F.col("text_id").isNull(), "text_id", "c"))
    rep = joined.groupBy("least").agg(first.alias("first")).select("least", F.col("first.text_id").alias("class_id"), F.col("first.c").alias("class_c"))
    classes = keep(joined.join(rep, "least").select("c", "class_id", "class_c", "text_id", (F.coalesce("doc_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_text_links")), "classes")
    # Documents that are alone are their class; only the others are looked up.
    grouped = classes.where("n_links > 0 or class_id <> text_id")
    out = light.select(id_col, "c").join(sized(grouped), "c", "left")
    alone = F.col("n_links").isNull()
    own = F.when(alone, F.col(id_col))
    return out.select(id_col, own.otherwise(F.col("class_id")).alias("class_id"), own.otherwise(F.col("text_id")).alias("text_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), "c", F.coalesce("class_c", "c").alias("class_c"))


def join(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each document: id_col, class_id (the smallest id of its class), text_id (the smallest id with the same
    n-gram set), n_links (documents linked to it directly, copies included), n_text_links (linked n-gram sets other than its own).

    Null and wordless texts have no links; their class is their own id. A null id takes part, and is reported as
    such where no other id is in its class. Repeated rows are copies. Extra columns are ignored.
    """
    return classified(docs, text, id_col, words, threshold, recall).drop("c", "class_c")


def with_class(docs: DataFrame, text: str, words: int, name: str) -> DataFrame:
    """The rows with their text class in a column of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, text):
            grams, offs = gram_sets(shard.column(shard.schema.get_field_index(text)), words)
            c = pa.array(set_hash(grams, offs).view(np.int64), mask=np.diff(offs) == 0)
            yield pa.RecordBatch.from_arrays([*shard.columns, c], [*shard.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, **options) -> DataFrame:
    """One document of each class, with its columns: that with the smallest id, of its texts one.

    It is decided by id and text class, so a null id, or one that several texts have, loses no text that
    another document doesn't stand for. Null ids stay only if no other id is in their class, and then one of them.
    """
    found = keep(classified(docs, text, id_col, words, **options), "found")
    # names that no column of docs has
    this, own, other, other_class = unused(docs, "this_id", "this_class", "other_id", "other_class")
    mine = F.col("class_id").eqNullSafe(F.col(this)) & (F.col("c") == F.col("class_c"))
    found = found.withColumnRenamed(id_col, this)
    fates = found.select(F.col(this), F.col("c").alias(own), ((F.col("n_links") > 0) & ~mine).alias("gone"), ((F.col("n_links") > 0) & mine).alias("first"))
    rows = fates.groupBy(this).agg(F.max("gone").alias("some"), F.min("gone").alias("all"), F.max("first").alias("first"), F.count("*").alias("rows"))
    rows = keep(rows.where("some or first and rows > 1"), "fates")
    drop = rows.where("all").select(F.col(this).alias(other))
    # ids of which some rows stay and others do not, or a row that stays may be repeated
    mixed = rows.where("not all").select(F.col(this).alias(other))
    same_id = F.col(id_col).eqNullSafe(F.col(other))
    out = docs.join(sized(drop), same_id, "left_anti")
    if mixed.isEmpty():
        return out
    part = with_class(out.join(sized(mixed), same_id, "left_semi"), text, words, own)
    of_mixed = fates.join(sized(mixed), F.col(this).eqNullSafe(F.col(other)), "left_semi")
    row = same_id & F.col(own).eqNullSafe(F.col(other_class))
    picked = lambda which: of_mixed.where(which).select(F.col(this).alias(other), F.col(own).alias(other_class)).distinct()
    less, once = picked("gone"), picked("first")
    part = part.join(sized(less), row, "left_anti")
    again = part.join(sized(once), row, "left_semi").dropDuplicates([id_col, own])
    part = part.join(sized(once), row, "left_anti").unionByName(again).drop(own)
    return out.join(sized(mixed), same_id, "left_anti").unionByName(part)
