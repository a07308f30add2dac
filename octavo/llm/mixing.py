"""Mixing sources to target weights by a low-discrepancy schedule.

The schedule's slots are points of the golden-ratio sequence, mapped through the sources' cumulative
target weights. Each source's documents, in an order shuffled by a hash of their id, form a stream that is
read up to ``cap`` times and ends at the source's target; it is cut into blocks of equally many words. The
k-th slot of a source takes its k-th block, so every stretch of the schedule holds the sources nearly in
their shares.

All sums over a source are taken in two steps (within chunks, then over chunks), so a source with any
share of the rows is spread over many tasks; only rows of (source, chunk) meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octavo.llm.shared import keep, sized, unused

#: Words: all but the space and the characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
PHI = 0.6180339887498949
#: Words of a block: enough slots for each source at small sizes, at most MOST.
LEAST, MOST = 16, 1024
#: Bins of [0, 1) through which slots find their source by an equi-join.
BINS = 4096
#: Rows or slots meant for one task: at most CHUNK, and fewer if there are fewer than SPREAD times as many.
CHUNK, SPREAD = 1 << 15, 512


def measured(docs: DataFrame, text: str, id_col: str, source: str) -> DataFrame:
    """id, source, size in words (null: 0) and the shuffle key, in the shared folder."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return keep(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), size.alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key")), "sizes")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Per source: k (place by code point, null last), source_size, target, n_docs.

    Sources take ``share`` of all words by weight; one that reaches ``cap`` times its size stops there and
    the excess goes to the others by weight, until none is above. With the sources in ascending order of
    cap per weight and all before some source capped, the rest per weight grows as long as sources are
    capped rightly and falls after that, so its maximum is the level of the sources that aren't capped.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by = by.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod("k", F.lit(len(weights))).cast("int") + 1)
    by = by.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    upto = Window.orderBy(F.col("cap") / F.col("w"), "k")
    by = by.withColumn("rest", F.lit(float(share)) * F.sum("source_size").over(every) - (F.sum("cap").over(upto) - F.col("cap")))
    by = by.withColumn("level", F.col("rest") / (F.sum("w").over(every) - (F.sum("w").over(upto) - F.col("w"))))
    target = F.least("cap", F.col("w") * F.max("level").over(every))
    return by.select("source", "k", "source_size", target.alias("target"), "n_docs")


def _before(df: DataFrame, key: list[str], chunk: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over earlier rows with the same key, in order of chunk and then ``order``."""
    v = df.withColumn("_v", value)
    sums = v.groupBy(*key, chunk).agg(F.sum("_v").alias("_s"))
    base = sums.select(*key, chunk, (F.sum("_s").over(Window.partitionBy(*key).orderBy(chunk)) - F.col("_s")).alias("_base"))
    inside = F.sum("_v").over(Window.partitionBy(*key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_v")
    return v.withColumn("_in", inside).join(sized(base), [*key, chunk]).withColumn(name, F.col("_base") + F.col("_in")).drop("_v", "_in", "_base")


class Mix:
    """``sources``: targets. ``docs``: id, source, size, k and the place in the source's stream. ``plan``: the schedule's pieces."""

    def __init__(self, sources: DataFrame, docs: DataFrame, plan: DataFrame, block: int, cap: float):
        self.sources, self.docs, self.plan, self.block, self.cap = sources, docs, plan, block, cap


def schedule(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2) -> Mix:
    """The mix of all documents.

    ``plan`` has a row for each piece of a document in a block: slot (its place in the mix), k (source),
    block, pass (0 for the first reading), place, from_word, to_word. Null texts have size 0; a null source
    is a source, the last. Documents without words are in no piece. Repeated rows are documents of their
    own. ``cap`` is a whole number.
    """
    spark = docs.sparkSession
    sizes = measured(docs, text, id_col, source)
    sources = keep(targets(sizes, weights, share, cap), "sources")
    n_sources, total = sources.agg(F.count("*"), F.sum("target")).first()
    n_docs = sizes.count()
    total = float(total or 0)
    block = int(max(LEAST, min(MOST, total // (2000 * max(1, n_sources)))))
    # Streams: documents by key. Each source is cut into as many ranges of keys as give chunks of the same size.
    each = max(64, min(CHUNK, n_docs // SPREAD))
    named = sources.select(F.col("source").alias("_s"), "k", "source_size", "target", F.greatest(F.ceil(F.col("n_docs") / each), F.lit(1)).alias("_c"))
    placed = sizes.join(sized(named, n_sources), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    first = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("chunk", F.floor(first * F.col("_c") / (1 << 32)).cast("long")).drop("_c")
    placed = _before(placed, ["k"], "chunk", [F.col("key"), F.col("id"), F.col("size")], F.col("size"), "place").drop("chunk")
    placed = keep(placed, "placed")
    # Blocks: what of each document lies in which block of its source, for each reading, up to the target.
    end = F.floor(F.col("target") + 0.5).cast("long")
    pieces = placed.where("size > 0").withColumn("pass", F.explode(F.array(*(F.lit(i).cast("long") for i in range(int(cap))))))
    pieces = pieces.withColumn("lo", F.col("pass") * F.col("source_size") + F.col("place")).withColumn("hi", F.least(F.col("lo") + F.col("size"), end)).where("lo < hi")
    pieces = pieces.select("id", "k", "place", "pass", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))).alias("block"))
    begin, stop = F.greatest("lo", F.col("block") * block), F.least("hi", (F.col("block") + 1) * block)
    pieces = pieces.select("id", "k", "place", "pass", "block", (begin - F.col("lo")).alias("from_word"), (stop - F.col("lo")).alias("to_word"))
    # Slots: sources by their blocks. An interval of length p has a golden-ratio point among any 2.62 / p in a row.
    n_blocks = sources.agg(F.sum(F.ceil(F.floor(F.col("target") + 0.5) / block))).first()[0] or 0
    n_slots = int(2.7 * int(n_blocks)) + 8
    parts = sources.withColumn("n", F.ceil(F.floor(F.col("target") + 0.5) / block).cast("double")).where("n > 0")
    w = Window.orderBy("k")
    ranges = parts.select("k", ((F.sum("n").over(w) - F.col("n")) / int(n_blocks or 1)).alias("a"), (F.sum("n").over(w) / int(n_blocks or 1)).alias("b"))
    last = F.col("b") == F.max("b").over(Window.partitionBy())
    ranges = ranges.withColumn("b", F.when(last, F.lit(1.0)).otherwise(F.col("b")))
    ranges = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") * BINS), F.least(F.floor(F.col("b") * BINS), F.lit(BINS - 1)))))
    point = (F.col("id") + 1) * PHI
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u")).withColumn("bin", F.floor(F.col("u") * BINS))
    slots = slots.join(sized(ranges), "bin").where("u >= a and u < b").select("slot", "k", F.expr(f"slot div {max(64, min(CHUNK, n_slots // SPREAD))}").alias("chunk"))
    ranked = _before(slots, ["k"], "chunk", [F.col("slot")], F.lit(1), "block").drop("chunk")
    return Mix(sources, placed, ranked.join(pieces, ["k", "block"]), block, cap)


def taken(mix: Mix) -> DataFrame:
    """Per document: id, size, source, k, source_size, target, place, and taken: its words in the mix, repeats counted."""
    got = mix.plan.groupBy("k", "place").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    full = mix.docs.where("size > 0").join(got, ["k", "place"], "left")
    none = mix.docs.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    return full.unionByName(none).withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The documents of the mix with their columns: once for each reading of which the mix takes at least half of the document.

    Each source's stream is read in order, so a reading takes a document if its key is not above the last
    one taken; one row for each source and reading decides that, and the texts are not shuffled.
    """
    mix = schedule(docs, id_col=id_col, source=source, **options)
    half = (mix.plan.groupBy("k", "place", "pass").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n"))).join(mix.docs.where("size > 0"), ["k", "place"]).where("2 * n >= size")
    last = keep(half.groupBy("source", "pass").agg(F.max(F.struct("key", "id")).alias("last")), "last")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    worded = F.coalesce(F.regexp_count(F.col(options.get("text", "text")), F.lit(WORD)), F.lit(0)) > 0
    of, limit = unused(docs, "source_of", "limit")
    out = docs.join(sized(last.select(F.col("source").alias(of), F.col("last").alias(limit))), F.col(source).eqNullSafe(F.col(of)))
    return out.where(worded & (F.struct(key.alias("key"), F.col(id_col).alias("id")) <= F.col(limit))).drop(of, limit)
