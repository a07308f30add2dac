"""Element interpolation onto lattice nodes: a binned range join, then inverse mapping.

Nodes lie on the lattice of one level; an element meets only the nodes in its own index box, so the join
explodes that box and is an equi-join on the node, with no theta join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.functions.cells import Cube, axes, index_names, key_names, left, node_names
from octavo.functions.vectors import simplex_inside, tetrahedron_barycentric, triangle_barycentric
from octavo.operators.mesh import RING, element_nodes, refined, simplices

# Fixed values of the inverse mapping: margin of inside, residual and number of steps of Newton's method.
MARGIN = {2: 1 + 1e-4, 3: 1 + 1e-3}
RESIDUAL, STEPS, FAR = 1e-5, 11, 2.0


def candidates(elements: DataFrame, nodes: DataFrame, cube: Cube, level: int) -> DataFrame:
    """(zone_id, element_id, node) pairs whose node's position may be in the element: the element's index box, cut to the lattice."""
    dim, n = cube.dim, 1 << level
    step = cube.size / n
    boxes = element_nodes(elements, nodes).groupBy("zone_id", "element_id").agg(*(f(a).alias(f"{k}_{a}") for a in axes(dim) for k, f in (("min", F.min), ("max", F.max))))
    rows = boxes
    for a, m, lo in zip(axes(dim), node_names(dim), cube.mins, strict=True):
        first = F.greatest(F.ceil((F.col(f"min_{a}") - lo) / step - 1e-9), F.lit(0)).cast("int")
        last = F.least(F.floor((F.col(f"max_{a}") - lo) / step + 1e-9), F.lit(n)).cast("int")
        rows = rows.withColumn(m, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    return rows.select("zone_id", "element_id", *node_names(dim))


def _positions(rows: DataFrame, cube: Cube, level: int) -> DataFrame:
    step = cube.size / (1 << level)
    return rows.select("*", *((F.lit(lo) + F.col(m) * step).alias(a) for a, m, lo in zip(axes(cube.dim), node_names(cube.dim), cube.mins, strict=True)))


def simplex_map(elements: DataFrame, nodes: DataFrame, cube: Cube, level: int) -> DataFrame:
    """The field map by simplices: zone_id, element_id, simplex, node, weights of the simplex's corners and their node ids."""
    dim = cube.dim
    parts = simplices(elements)
    keyed = parts.select("zone_id", F.concat_ws(":", "element_id", "simplex").alias("element_id"), "nodes", F.col("element_id").alias("_e"), "simplex")
    pairs = candidates(keyed, nodes, cube, level)
    corners = element_nodes(keyed, nodes.select("zone_id", "node_id", *axes(dim)))
    shape = corners.groupBy("zone_id", "element_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", *axes(dim)))).alias("k"))
    rows = _positions(pairs, cube, level).join(shape, ["zone_id", "element_id"])
    corner = lambda i: [F.get("k", F.lit(i))[a] for a in axes(dim)]
    here = [F.col(a) for a in axes(dim)]
    weights = triangle_barycentric(here, *(corner(i) for i in range(3))) if dim == 2 else tetrahedron_barycentric(here, *(corner(i) for i in range(4)))
    rows = rows.where(simplex_inside(weights))
    first = F.lit(1.0)
    for w in weights:
        first = first - w
    out = rows.join(keyed.select("zone_id", "element_id", "_e", "simplex"), ["zone_id", "element_id"])
    return out.select("zone_id", F.col("_e").alias("element_id"), "simplex", *node_names(dim), F.array(first, *weights).alias("p"), F.transform("k", lambda x: x["node_id"]).alias("corners"))


def inverse_map(p: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local coordinates in [-1, 1] of points in quads or hexahedra, by Newton's method on all at once.

    p: (n, dim); corners: (n, 2^dim, dim) in bit order. Returns coordinates, inside, converged. What does not
    converge keeps the verdict of the linear guess.
    """
    n, size, dim = corners.shape
    signs = np.array([[1.0 if c >> d & 1 else -1.0 for d in range(dim)] for c in range(size)])
    linear = np.einsum("nca,cd->nad", corners, signs) / size
    centre = corners.mean(1)
    det = np.linalg.det(linear)
    ok = np.abs(det) > 1e-300
    safe = np.where(ok[:, None, None], linear, np.eye(dim))
    xi = np.linalg.solve(safe, (p - centre)[:, :, None])[:, :, 0]
    margin = MARGIN[dim]
    guess = (np.abs(xi) <= margin).all(1) & ok
    far = (np.abs(xi) > FAR).any(1) | ~ok
    scale = np.abs(linear).sum((1, 2))
    converged = np.zeros(n, bool)
    for _ in range(STEPS + 1):
        shape = np.prod(1 + signs[None] * xi[:, None, :], axis=2) / size
        f = np.einsum("nc,nca->na", shape, corners) - p
        converged |= np.abs(f).sum(1) <= RESIDUAL * scale
        todo = ~converged & ~far
        if not todo.any():
            break
        jac = np.empty((n, dim, dim))
        for d in range(dim):
            others = np.prod(np.where(np.arange(dim)[None, None] == d, 1.0, 1 + signs[None] * xi[:, None, :]), axis=2) * signs[None, :, d] / size
            jac[:, :, d] = np.einsum("nc,nca->na", others, corners)
        fine = todo & (np.abs(np.linalg.det(jac)) > 1e-300)
        xi[fine] -= np.linalg.solve(jac[fine], f[fine][:, :, None])[:, :, 0]
        far |= todo & ~fine
    inside = np.where(converged, (np.abs(xi) <= margin).all(1), guess) & ~(far & ~converged)
    return xi, inside, converged | far


def cube_map(elements: DataFrame, nodes: DataFrame, cube: Cube, level: int) -> DataFrame:
    """The field map by quads or hexahedra: local coordinates ``p``, corner node ids in bit order, ``bad`` for points whose inversion failed."""
    dim = cube.dim
    ring = RING[dim]
    pairs = candidates(elements, nodes, cube, level)
    shape = element_nodes(elements, nodes.select("zone_id", "node_id", *axes(dim))).groupBy("zone_id", "element_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", *axes(dim)))).alias("k"))
    rows = _positions(pairs, cube, level).join(shape, ["zone_id", "element_id"])
    rows = rows.select("zone_id", "element_id", *node_names(dim), *axes(dim), F.array(*(F.get("k", F.lit(i))["node_id"] for i in ring)).alias("corners"), F.array(*(F.get("k", F.lit(i))[a] for i in ring for a in axes(dim))).alias("xyz"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                corners = np.stack(df["xyz"].to_numpy()).reshape(len(df), 1 << dim, dim)
                xi, inside, good = inverse_map(df[list(axes(dim))].to_numpy(float), corners)
                df = df.assign(p=list(xi), bad=~good)[inside]
                yield df[["zone_id", "element_id", *node_names(dim), "p", "corners", "bad"]]

    kinds = dict(rows.dtypes)
    schema = f"zone_id {kinds['zone_id']}, element_id {kinds['element_id']}, " + ", ".join(f"{m} int" for m in node_names(dim)) + f", p array<double>, corners {kinds['corners']}, bad boolean"
    return rows.mapInPandas(run, schema)


def subtree_map(elements: DataFrame, nodes: DataFrame, cube: Cube, subtrees: DataFrame, corners: DataFrame) -> DataFrame:
    """The field map of the nodes of all stored subtrees (key, depth, node): as ``cube_map`` and ``simplex_map``, per subtree.

    corners: the distinct nodes of each subtree. An element meets the subtrees whose cube its box touches, level by
    level, and of these the lattice nodes in its box; all that by keys. Whole quads and hexahedra are inverted, others
    are cut into simplices. Columns: key, node, zone_id, element_id, simplex, nodes and weights ``w`` of these.
    """
    dim = cube.dim
    keys = key_names(dim)
    boxes = element_nodes(elements, nodes).groupBy("zone_id", "element_id").agg(*(f(a).alias(f"{k}_{a}") for a in axes(dim) for k, f in (("min", F.min), ("max", F.max))))
    levels = [r.level for r in subtrees.select("level").distinct().collect()]  # at most some twenty
    rows = boxes.withColumn("level", F.explode(F.array(*(F.lit(x) for x in sorted(levels)))))
    size, tol = cube.block_size(F.col("level")), 1e-9
    n = left(F.lit(1), F.col("level"))
    for a, i, lo in zip(axes(dim), index_names(dim), cube.mins, strict=True):
        first = F.greatest(F.ceil((F.col(f"min_{a}") - lo) / size - tol) - 1, F.lit(0)).cast("int")
        last = F.least(F.floor((F.col(f"max_{a}") - lo) / size + tol), n - 1).cast("int")
        rows = rows.withColumn(i, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    rows = rows.join(subtrees.select(*keys, "depth"), keys)
    step = size / left(F.lit(1), F.col("depth"))
    for a, i, m, lo in zip(axes(dim), index_names(dim), node_names(dim), cube.mins, strict=True):
        begin = F.lit(lo) + F.col(i) * size
        first = F.greatest(F.ceil((F.col(f"min_{a}") - begin) / step - tol), F.lit(0)).cast("int")
        last = F.least(F.floor((F.col(f"max_{a}") - begin) / step + tol), left(F.lit(1), F.col("depth"))).cast("int")
        rows = rows.withColumn(m, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    rows = rows.select("zone_id", "element_id", *keys, "depth", *node_names(dim)).join(corners.select(*keys, *node_names(dim)), [*keys, *node_names(dim)], "left_semi")
    step = cube.block_size(F.col("level")) / left(F.lit(1), F.col("depth"))
    rows = rows.select("*", *((F.lit(lo) + F.col(i) * cube.block_size(F.col("level")) + F.col(m) * step).alias(a) for a, i, m, lo in zip(axes(dim), index_names(dim), node_names(dim), cube.mins, strict=True)))
    shape = element_nodes(elements, nodes.select("zone_id", "node_id", *axes(dim))).groupBy("zone_id", "element_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", *axes(dim)))).alias("k"))
    at = [*keys, *node_names(dim)]
    # whole quads and hexahedra
    ring = RING[dim]
    whole = rows.join(shape.where(F.size("k") == 1 << dim), ["zone_id", "element_id"])
    whole = whole.select("zone_id", "element_id", *at, *axes(dim), F.array(*(F.get("k", F.lit(i))["node_id"] for i in ring)).alias("corners"), F.array(*(F.get("k", F.lit(i))[a] for i in ring for a in axes(dim))).alias("xyz"))
    kinds = dict(whole.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signs = np.array([[1.0 if c >> d & 1 else -1.0 for d in range(dim)] for c in range(1 << dim)])
        for df in frames:
            if len(df):
                xi, inside, _ = inverse_map(df[list(axes(dim))].to_numpy(float), np.stack(df["xyz"].to_numpy()).reshape(len(df), 1 << dim, dim))
                w = np.prod(1 + signs[None] * xi[:, None, :], axis=2) / (1 << dim)
                df = df.assign(w=list(w), simplex=np.int32(0))[inside]
                yield df[["zone_id", "element_id", "simplex", *at, "corners", "w"]]

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ("zone_id", "element_id")), "simplex int", *(f"{c} {kinds[c]}" for c in at), f"corners {kinds['corners']}", "w array<double>"])
    mapped = whole.mapInPandas(run, schema)
    # elements that lack nodes, and simplices
    part = elements.join(shape.where(F.size("k") != 1 << dim).select("zone_id", "element_id"), ["zone_id", "element_id"], "left_semi")
    if part.isEmpty():
        return mapped
    cut = simplices(part)
    each = element_nodes(cut.select("zone_id", F.struct("element_id", "simplex").alias("element_id"), "nodes"), nodes.select("zone_id", "node_id", *axes(dim)))
    each = each.groupBy("zone_id", "element_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", *axes(dim)))).alias("k")).select("zone_id", "element_id.element_id", "element_id.simplex", "k")
    some = rows.join(each, ["zone_id", "element_id"])
    corner = lambda i: [F.get("k", F.lit(i))[a] for a in axes(dim)]
    here = [F.col(a) for a in axes(dim)]
    weights = triangle_barycentric(here, *(corner(i) for i in range(3))) if dim == 2 else tetrahedron_barycentric(here, *(corner(i) for i in range(4)))
    first = F.lit(1.0)
    for w in weights:
        first = first - w
    some = some.where(simplex_inside(weights)).select("zone_id", "element_id", F.col("simplex").cast("int").alias("simplex"), *at, F.transform("k", lambda x: x["node_id"]).alias("corners"), F.array(first, *weights).alias("w"))
    return mapped.unionByName(some)


def apply_subtree_map(field_map: DataFrame, values: DataFrame, dim: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Values (zone_id, node_id, ``by``, v) at the nodes of stored subtrees: the last (zone, element, simplex) of a node counts."""
    at = [*key_names(dim), *node_names(dim)]
    last = field_map.groupBy(*at).agg(F.max_by(F.struct("zone_id", "corners", "w"), F.struct("zone_id", "element_id", "simplex")).alias("m"))
    corners = F.transform(F.col("m.corners"), lambda c, i: F.struct(c.alias("node_id"), F.get(F.col("m.w"), i).alias("w")))
    each = last.select(*at, "m.zone_id", F.size("m.corners").alias("_n"), F.explode(corners).alias("_c")).select(*at, "zone_id", "_n", "_c.node_id", "_c.w")
    sums = each.join(values, ["zone_id", "node_id"]).groupBy(*by, *at, "_n").agg(F.sum(F.col("v") * F.col("w")).alias("value"), F.count("v").alias("_k"))
    return sums.where("_k = _n").drop("_k", "_n")  # a value that one of the corners lacks is no value


def apply_map(field_map: DataFrame, nodes: DataFrame, field: str, dim: int, first_wins: bool = False) -> DataFrame:
    """Values at mapped nodes: corner values weighted, then one record for each node.

    The last (zone, element, simplex) wins, as for a stored map; with ``first_wins`` the first, as for direct interpolation.
    """
    simplex = "simplex" in field_map.columns
    rows = field_map if simplex else field_map.withColumn("simplex", F.lit(0))
    each = rows.select("zone_id", "element_id", "simplex", *node_names(dim), "p", F.posexplode("corners").alias("c", "node_id"))
    each = each.join(nodes.select("zone_id", "node_id", F.col(field).alias("_v")), ["zone_id", "node_id"])
    if simplex:
        weight = F.get("p", F.col("c"))
    else:
        weight = F.lit(1.0)
        for d in range(dim):
            sign = F.when(F.call_function("shiftright", F.col("c"), F.lit(d)).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
            weight = weight * (1 + sign * F.get("p", F.lit(d))) / 2
    values = each.groupBy("zone_id", "element_id", "simplex", *node_names(dim)).agg(F.sum(F.col("_v") * weight).alias("value"))
    order = F.struct("zone_id", "element_id", "simplex")
    pick = F.min_by("value", order) if first_wins else F.max_by("value", order)
    return values.groupBy(*node_names(dim)).agg(pick.alias("value"))


def bad_elements(field_map: DataFrame) -> DataFrame:
    """How many mapped points' inversions failed."""
    return field_map.agg(F.count_if("bad").alias("bad"), F.count("*").alias("mapped"))


def without_covered(pairs: DataFrame, covered: DataFrame, dim: int) -> DataFrame:
    """Pairs whose node no propagated child has covered already."""
    return pairs.join(covered.select(*node_names(dim)).distinct(), node_names(dim), "left_anti")


def nodes_in_box(nodes: DataFrame, lo: tuple[int, ...], hi: tuple[int, ...]) -> DataFrame:
    """Nodes with lo <= index < hi on every axis."""
    for m, a, b in zip(node_names(len(lo)), lo, hi, strict=True):
        nodes = nodes.where((F.col(m) >= a) & (F.col(m) < b))
    return nodes


def refined_points(elements: DataFrame, nodes: DataFrame, field: str, dim: int, param: float) -> DataFrame:
    """Elements' refinement lattices with the field interpolated over each element: axes and the field."""
    return refined(elements, nodes, dim, param, (field,)).select("zone_id", "element_id", *axes(dim), field)


def write_field_map(field_map: DataFrame, path: str) -> None:
    """The element to node incidence, kept for all frames; by zone, in order of node."""
    names = [c for c in field_map.columns if c in node_names(3)]
    field_map.repartitionByRange("zone_id", *names).sortWithinPartitions("zone_id", *names).write.mode("overwrite").parquet(path)


def read_field_map(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
