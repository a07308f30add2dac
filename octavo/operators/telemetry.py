"""Timing-log analytics: shifts, stage durations, per-frame tables, projections, unions, timelines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The stages of a record in order; a record's sequence ends with End.
STAGES = ["ClearViewport", "SortBlocks", "BlocksOverhead", "SetField", "SetPrimary", "SetSecondary", "SetTransfer", "Render", "ClipOverhead", "Copy", "Crop", "Store"]


def summary(rows: DataFrame) -> DataFrame:
    """Frames, and levels (1 + the largest of the first frame)."""
    first = rows.agg(F.min("frame").alias("f"))
    levels = rows.join(F.broadcast(first), F.col("frame") == F.col("f")).agg((F.max("level") + 1).alias("levels"))
    return rows.agg(F.count_distinct("frame").alias("frames")).join(levels)


def shifted(rows: DataFrame, times: list[str], start: str = "start") -> DataFrame:
    """Times from the start of their frame."""
    base = F.min(start).over(Window.partitionBy("frame"))
    return rows.withColumn("_base", base).select(*(c for c in rows.columns if c not in times), *((F.col(t) - F.col("_base")).alias(t) for t in times))


def bars(rows: DataFrame, keys: list[str], order: list[str], time: str, stage: str) -> DataFrame:
    """Each record's stages in order with their position."""
    by = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(time).alias("time"), F.col(stage).alias("type")))).alias("s"))
    return by.select(*keys, F.posexplode("s").alias("pos", "b")).select(*keys, "pos", "b.time", "b.type")


def durations(rows: DataFrame, keys: list[str], order: list[str], time: str) -> DataFrame:
    """Each stage's time until the next of its record (null for the last)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("duration", F.lead(time).over(w) - F.col(time))


def checked_monotone(rows: DataFrame, keys: list[str], order: list[str], time: str) -> DataFrame:
    """The rows; a time that falls within a record is an error."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_bad", F.lag(time).over(w) > F.col(time)).where(F.when(F.coalesce("_bad", F.lit(False)), F.raise_error(F.lit("times are not monotone"))).otherwise(True)).drop("_bad")


def falls(rows: DataFrame, keys: list[str], order: list[str], time: str) -> DataFrame:
    """How often a time falls, by record."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_bad", F.lag(time).over(w) > F.col(time)).groupBy(*keys).agg(F.count_if("_bad").alias("falls"))


def task_durations(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Per (level, frame): the wall span, and the shortest and longest task."""
    d = F.col(end) - F.col(start)
    return rows.groupBy("level", "frame").agg((F.max(end) - F.min(start)).alias("span"), F.min(d).alias("min_task"), F.max(d).alias("max_task"))


def stage_statistics(rows: DataFrame, keys: list[str], stage: str, duration: str, stages: list[str]) -> DataFrame:
    """Wide table: count, min, max (0 where none) and avg (null where none) of each stage. The stages are given, so
    the schema is the same for any data; one aggregation with conditional sums."""
    aggs = []
    for s in stages:
        own = F.when(F.col(stage) == s, F.col(duration))
        aggs += [F.count(own).alias(f"{s}_count"), F.coalesce(F.min(own), F.lit(0.0)).alias(f"{s}_min"), F.coalesce(F.max(own), F.lit(0.0)).alias(f"{s}_max"), F.avg(own).alias(f"{s}_avg")]
    return rows.groupBy(*keys).agg(*aggs)


def frame_range(text: str, frames: int) -> tuple[int, int] | None:
    """``a-b``, ``a-$`` or ``none``; both ends inclusive."""
    if text == "none":
        return None
    m = re.fullmatch(r"(\d+)-(\d+|\$)", text)
    if not m:
        raise ValueError(f"not a frame range: {text!r}")
    a, b = int(m[1]), frames - 1 if m[2] == "$" else int(m[2])
    if a > b or b >= frames:
        raise ValueError("frame range is reversed or out of range")
    return a, b


def averaged(table: DataFrame, keys: list[str], first: int, last: int, number: str = "frame_no") -> DataFrame:
    """One row for each key: the mean of every other column over rows first to last."""
    columns = [c for c in table.columns if c not in (*keys, number)]
    return table.where(F.col(number).between(first, last)).groupBy(*keys).agg(*(F.avg(c).alias(c) for c in columns))


def matching_columns(columns: list[str], pattern: str) -> list[str]:
    """Columns whose whole name matches; all if the pattern is empty."""
    return [c for c in columns if not pattern or re.fullmatch(pattern, c)]


def projected(table: DataFrame, pattern: str) -> DataFrame:
    return table.select(*matching_columns(table.columns, pattern))


def averaged_and_projected(table: DataFrame, keys: list[str], first: int, last: int, pattern: str, number: str = "frame_no") -> DataFrame:
    return projected(averaged(table, keys, first, last, number), pattern)


def labelled(table: DataFrame, **constants) -> DataFrame:
    """Rows that aren't all null, with constant columns."""
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in table.columns])
    return table.where(some).select(*(F.lit(v).alias(k) for k, v in constants.items()), *table.columns)


def union_sorted(tables: list[DataFrame], order: list[str]) -> DataFrame:
    """Tables with one header put together, in the order of several columns as text."""
    whole = reduce(lambda a, b: a.unionByName(b), tables)
    return whole.orderBy(*(F.col(c).cast("string") for c in order))


def timeline(rows: DataFrame, start: str, duration: str, row: Column, height: int) -> DataFrame:
    """Bars as rectangles, one pixel for a millisecond; empty ones are dropped."""
    x0 = F.floor(F.col(start) * 1000).cast("long")
    x1 = F.floor((F.col(start) + F.col(duration)) * 1000).cast("long")
    return rows.select("*", x0.alias("x"), (row * height).alias("y"), (x1 - x0).alias("w"), F.lit(height).alias("h")).where("w > 0")


def legend(stages: list[str] = STAGES, height: int = 16) -> list[tuple[str, int]]:
    return [(s, i * height) for i, s in enumerate(stages)]


def without_stale(rows: DataFrame, start: str = "start", frame: str = "frame") -> DataFrame:
    """Drops what a frame kept from before: in the first, starts of 0; later, starts not after the frame before's last."""
    last = rows.groupBy(frame).agg(F.max(start).alias("m"))
    before = last.select(F.col(frame).alias("_f"), F.lag("m").over(Window.orderBy(frame)).alias("_before"))
    out = rows.join(before, F.col(frame) == F.col("_f"))
    return out.where(F.when(F.col("_before").isNull(), F.col(start) != 0).otherwise(F.col(start) > F.col("_before"))).drop("_f", "_before")


def of_level(rows: DataFrame, **equal) -> DataFrame:
    """Equality filter on level, thread or node."""
    for k, v in equal.items():
        rows = rows.where(F.col(k) == v)
    return rows
