"""Prefix sums and ranks over large groups in two steps: within chunks, then over chunk totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_before(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over earlier rows with the same keys.

    ``chunk`` must grow with the order. Rows of one (keys, chunk) meet in a task; of other rows only totals do.
    """
    rows = df.withColumn("_c", chunk).withColumn("_v", value)
    totals = rows.groupBy(*keys, "_c").agg(F.sum("_v").alias("_t"))
    over = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_c")
    base = totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_c").alias("_bc"), (F.sum("_t").over(over) - F.col("_t")).alias("_b"))
    inside = F.sum("_v").over(Window.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_v")
    on = F.col("_c").eqNullSafe(F.col("_bc"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.withColumn("_i", inside).join(base, on).withColumn(name, F.col("_b") + F.col("_i"))
    return out.drop("_c", "_bc", "_v", "_i", "_b", *(f"_k_{k}" for k in keys))


def rank_before(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the number of earlier rows with the same keys (0 for the first)."""
    return sum_before(df, keys, chunk, order, F.lit(1).cast("long"), name)
