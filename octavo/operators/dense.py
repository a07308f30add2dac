"""Sparse subtree fields to dense lattices.

``scatter`` and ``fill_level`` are DataFrame operations; ``fill`` does all levels of a subtree on a NumPy cube,
one group for each subtree and field, whose size (2^depth + 1)^dim is fixed by the storage depth.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octavo.functions.cells import node_names
from octavo.operators.mesh import odometer


def lattice(spark: SparkSession, depth: int, dim: int) -> DataFrame:
    return odometer(spark, [(1 << depth) + 1] * dim, node_names(dim)).drop("id")


def scatter(sparse: DataFrame, depth: int, dim: int) -> DataFrame:
    """One subtree's whole lattice with the values there are."""
    return lattice(sparse.sparkSession, depth, dim).join(sparse.select(*node_names(dim), "value"), node_names(dim), "left")


def fill_level(dense: DataFrame, level: int, depth: int, dim: int) -> DataFrame:
    """Undefined midpoints of one level's blocks from their neighbours half a block away: an edge's from 2, a face's from
    4, the volume's from 6; missing if any of these is. Lower dimensions come first, so faces see filled edges."""
    half = 1 << (depth - level - 1)
    names = node_names(dim)
    out = dense
    for free in range(1, dim + 1):
        odd = [(F.col(m) / half).cast("int") % 2 == 1 for m in names]
        on = None
        for m in names:
            c = F.col(m) % half == 0
            on = c if on is None else on & c
        n_odd = sum((o.cast("int") for o in odd[1:]), odd[0].cast("int"))
        todo = out.where(on & (n_odd == free) & F.col("value").isNull())
        moves = None
        for d, m in enumerate(names):
            for sign in (-half, half):
                step = todo.where((F.col(m) / half).cast("int") % 2 == 1).select(*names, *((F.col(x) + (sign if i == d else 0)).alias(f"s_{x}") for i, x in enumerate(names)))
                moves = step if moves is None else moves.unionByName(step)
        source = out.select(*(F.col(m).alias(f"s_{m}") for m in names), F.col("value").alias("sv"))
        means = moves.join(source, [f"s_{m}" for m in names], "left").groupBy(*names).agg(F.when(F.count("sv") == 2 * free, F.avg("sv")).alias("_new"))
        out = out.join(means, names, "left").withColumn("value", F.coalesce("value", "_new")).drop("_new")
    return out


def fill_cube(v: np.ndarray) -> np.ndarray:
    """All levels of the midpoint fill; NaN is missing, and stays where a source is missing."""
    dim, size = v.ndim, v.shape[0] - 1
    half = size // 2
    while half >= 1:
        for free in range(1, dim + 1):
            for mask in range(1 << dim):
                if bin(mask).count("1") != free:
                    continue
                at = tuple(slice(half, size, 2 * half) if mask >> d & 1 else slice(0, size + 1, 2 * half) for d in range(dim))
                total = np.zeros_like(v[at])
                for d in range(dim):
                    if mask >> d & 1:
                        for begin in (0, 2 * half):
                            near = list(at)
                            near[d] = slice(begin, size + 1 if begin else size, 2 * half)
                            total = total + v[tuple(near)]
                mean = total / (2 * free)
                v[at] = np.where(np.isnan(v[at]), mean, v[at])
        half //= 2
    return v


def fill(sparse: DataFrame, keys: list[str], dim: int, depth: int) -> DataFrame:
    """Dense lattices of all subtrees: keys, node, value (null where missing). sparse: keys, node, value."""
    names = node_names(dim)
    side = (1 << depth) + 1
    kinds = dict(sparse.dtypes)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        v = np.full((side,) * dim, np.nan)
        v[tuple(df[m].to_numpy() for m in names)] = df["value"].to_numpy(float)
        v = fill_cube(v)
        grid = np.indices(v.shape)
        out = {k: df[k].iloc[0] for k in keys}
        out |= {m: grid[d].ravel().astype(np.int32) for d, m in enumerate(names)}
        flat = v.ravel()
        return pd.DataFrame(out | {"value": pd.Series(flat).where(~np.isnan(flat), None).astype(object)})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{m} int" for m in names), "value double"])
    return sparse.groupBy(*keys).applyInPandas(run, schema)


def dense_size(depth: int, dim: int) -> int:
    return ((1 << depth) + 1) ** dim


def normalized(dense: DataFrame, lo: float, hi: float) -> DataFrame:
    """Values over a range as 0 to 1; an empty range gives 0."""
    return dense.withColumn("value", (F.col("value") - lo) / (hi - lo) if hi > lo else F.when(F.col("value").isNotNull(), 0.0))
