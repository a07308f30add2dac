"""Fields on block corners: weighted means of points, functions, images, element interpolation, ranges, roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octavo.functions.cells import Cube, axes, bit, corner_bits, image_position, index_names, key_names, left, node_names, octant, right
from octavo.functions.vectors import signed_shift_right
from octavo.operators.tree import deepest_block
from octavo.storage import keep

#: Fixed values of the weighted mean: the least weight of a corner, and the least sum that counts.
LEAST_WEIGHT, LEAST_SUM = 2e-5, 1e-5


def corner_weights(points: DataFrame, cube: Cube, value: str, compat_axis_order: bool = False) -> DataFrame:
    """Points with a block (level, ix, ...) spread to its corners: columns of the point, ``c`` and the weight ``w``.

    A corner's weight is the product over the axes of t or 1 - t, with t the point's place in the block.
    ``compat_axis_order`` reverses the axes of the weights against those of the corners.
    """
    dim = cube.dim
    size = cube.block_size(F.col("level"))
    t = [(F.col(a) - m) / size for a, m in zip(axes(dim), cube.block_min(F.col("level"), [F.col(i) for i in index_names(dim)]), strict=True)]
    rows = points.select("*", *(x.alias(f"t_{a}") for a, x in zip(axes(dim), t, strict=True))).withColumn("c", F.explode(corner_bits(dim)))
    order = list(reversed(range(dim))) if compat_axis_order else list(range(dim))
    parts = [F.when(bit(F.col("c"), b) == 1, F.col(f"t_{axes(dim)[d]}")).otherwise(1 - F.col(f"t_{axes(dim)[d]}")) for b, d in enumerate(order)]
    w = reduce(lambda p, q: p * q, parts)
    return rows.withColumn("w", F.greatest(w, F.lit(LEAST_WEIGHT))).withColumn("v", F.col(value)).drop(*(f"t_{a}" for a in axes(dim)))


def weighted_mean(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of v by weight w; null where the weights hardly count."""
    sums = rows.where(F.col("v").isNotNull()).groupBy(*keys).agg(F.sum(F.col("v") * F.col("w")).alias("vw"), F.sum("w").alias("sw"))
    return sums.select(*keys, F.when(F.col("sw") >= LEAST_SUM, F.col("vw") / F.col("sw")).alias("value"))


def corner_mean(points: DataFrame, cube: Cube, level: int, value: str, compat_axis_order: bool = False) -> DataFrame:
    """The field of scattered points on the corners of one level's blocks (nx, ny, nz)."""
    dim = cube.dim
    cell = cube.cell([F.col(a) for a in axes(dim)], level)
    rows = points.withColumn("level", F.lit(level)).select("*", *(c.alias(n) for c, n in zip(cell, index_names(dim), strict=True)))
    rows = corner_weights(rows, cube, value, compat_axis_order)
    node = [(F.col(n) + bit(F.col("c"), d)).alias(m) for d, (n, m) in enumerate(zip(index_names(dim), node_names(dim), strict=True))]
    return weighted_mean(rows.select(*node, "v", "w"), node_names(dim))


def _root_node(dim: int, level: Column, index: list[Column]) -> list[Column]:
    """The corner ``c`` of a block in the lattice of the subtree s_* of depth ``depth``."""
    shift = F.col("depth") - (level - F.col("s_level"))
    mask = left(F.lit(1), F.col("depth")) - 1
    return [(left(i, shift).bitwiseAND(mask) + left(bit(F.col("c"), d), shift)).alias(m) for d, (i, m) in enumerate(zip(index, node_names(dim), strict=True))]


def _to_roots(rows: DataFrame, subtrees: DataFrame, dim: int) -> DataFrame:
    """Rows of a block at ``cut`` (b_ix, ...), ``own`` if it is the deepest one there, with every stored subtree that they count in:
    one that the block is in, at the subtree's depth if it is not the deepest. A block meets the roots up to the largest
    depth above it only, so no root meets more than its lattice."""
    reach = subtrees.agg(F.max("depth")).first()[0] or 0
    keys = [f"s_{k}" for k in key_names(dim)]
    rows = rows.withColumn("s_level", F.explode(F.sequence(F.greatest(F.col("cut") - reach, F.lit(0)), F.col("cut"))))
    rows = rows.select("*", *(right(F.col(f"b_{n}"), F.col("cut") - F.col("s_level")).alias(f"s_{n}") for n in index_names(dim)))
    roots = subtrees.select(*(F.col(k).alias(f"s_{k}") for k in key_names(dim)), "depth")
    below = F.col("cut") - F.col("s_level")
    return rows.join(roots, keys).where((F.col("own") & (below <= F.col("depth"))) | (below == F.col("depth")))


def subtree_mean(located: DataFrame, subtrees: DataFrame, cube: Cube, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The field of points with their deepest block, per stored subtree: each point counts in the blocks of every subtree
    above it, at the subtree's depth or its own block's.

    Points are summed per block and corner first; only those sums meet the subtrees. ``by``: more columns to keep apart.
    """
    dim = cube.dim
    rows = located.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("level")))).withColumn("own", F.col("cut") == F.col("level"))
    rows = rows.select(*(c for c in rows.columns if c not in key_names(dim)), F.col("cut").alias("level"), *(right(F.col(n), F.col("level") - F.col("cut")).alias(n) for n in index_names(dim)))
    rows = corner_weights(rows, cube, value).where(F.col("v").isNotNull())
    block = [F.col(n).alias(f"b_{n}") for n in index_names(dim)]
    sums = rows.groupBy(*by, "cut", "own", *block, "c").agg(F.sum(F.col("v") * F.col("w")).alias("vw"), F.sum("w").alias("sw"))
    rows = _to_roots(sums, subtrees, dim)
    node = _root_node(dim, F.col("cut"), [F.col(f"b_{n}") for n in index_names(dim)])
    keys = [f"s_{k}" for k in key_names(dim)]
    total = rows.select(*by, *keys, *node, "vw", "sw").groupBy(*by, *keys, *node_names(dim)).agg(F.sum("vw").alias("vw"), F.sum("sw").alias("sw"))
    mean = F.when(F.col("sw") >= LEAST_SUM, F.col("vw") / F.col("sw"))
    return total.select(*by, *(F.col(k).alias(k.removeprefix("s_")) for k in keys), *node_names(dim), mean.alias("value"))


def function_field(corners: DataFrame, f: Column) -> DataFrame:
    """Mean of a function over the blocks that touch a corner; NaN is missing. corners: keys and positions."""
    keys = [c for c in corners.columns if c not in axes(3)]
    v = F.when(F.isnan(f), None).otherwise(f)
    return corners.groupBy(*keys).agg(F.avg(v).alias("value"))


def exact_field(nodes: DataFrame, covered: DataFrame, keys: list[str], f: Column) -> DataFrame:
    """A function at the nodes that children do not cover already; theirs are kept."""
    out = nodes.join(covered.select(*keys, F.col("value").alias("_child")), keys, "left")
    return out.withColumn("value", F.coalesce(F.col("_child"), f)).drop("_child")


def image_points(voxels: DataFrame, dim: int, voxel: float = 1.0, mins: tuple[float, ...] | None = None) -> DataFrame:
    """Voxels as points at their centres."""
    mins = mins or (0.0,) * dim
    place = image_position([F.col(n) for n in index_names(dim)], mins, voxel)
    return voxels.select("*", *(p.alias(a) for p, a in zip(place, axes(dim), strict=True)))


def stencil(voxels: DataFrame, mask: Column) -> DataFrame:
    """The voxels in a domain."""
    return voxels.where(mask)


def sphere_mask(dim: int, centre: tuple[int, ...], radius: int) -> Column:
    """Integer distance from the centre at most the radius."""
    return reduce(lambda p, q: p + q, [(F.col(n) - c) * (F.col(n) - c) for n, c in zip(index_names(dim), centre, strict=True)]) <= radius * radius


def field_range(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Min and max of the values there are; 0 and -1 (an inverted range) where there is none."""
    agg = [F.coalesce(F.min(value), F.lit(0.0)).alias("min"), F.coalesce(F.max(value), F.lit(-1.0)).alias("max")]
    return values.groupBy(*keys).agg(*agg) if keys else values.agg(*agg)


def merged_range(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges put together; inverted ones are ignored."""
    some = F.col("max") >= F.col("min")
    agg = [F.coalesce(F.min(F.when(some, F.col("min"))), F.lit(0.0)).alias("min"), F.coalesce(F.max(F.when(some, F.col("max"))), F.lit(-1.0)).alias("max")]
    return ranges.groupBy(*keys).agg(*agg) if keys else ranges.agg(*agg)


def missing_fields(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """The (field, frame) pairs still to be generated."""
    return wanted.join(existing, ["field", "frame"], "left_anti")


def to_parent(children: DataFrame, subtrees: DataFrame, dim: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of child subtrees that coincide with nodes of the parent subtree: parent's key and node, and the value.

    children: subtree key, depth, node, value; subtrees: key, depth. With shift = child depth + 1 - parent depth, a
    node counts if shift < 1 or all its coordinates are even.
    """
    index = [F.col(n) for n in index_names(dim)]
    up = children.where("level > 0").select(*by, (F.col("level") - 1).alias("p_level"), *(right(i, 1).alias(f"p_{n}") for i, n in zip(index, index_names(dim), strict=True)), octant(index).alias("oct"), F.col("depth").alias("cd"), *node_names(dim), "value")
    roots = subtrees.select(F.col("level").alias("p_level"), *(F.col(n).alias(f"p_{n}") for n in index_names(dim)), F.col("depth").alias("pd"))
    up = up.join(roots, ["p_level", *(f"p_{n}" for n in index_names(dim))])
    shift = F.col("cd") + 1 - F.col("pd")
    even = reduce(lambda p, q: p & q, [F.col(m).bitwiseAND(F.lit(1)) == 0 for m in node_names(dim)])
    node = [(signed_shift_right(F.col(m), shift) + left(bit(F.col("oct"), d), F.greatest(F.col("pd") - 1, F.lit(0)))).alias(m) for d, m in enumerate(node_names(dim))]
    up = up.where((shift < 1) | even)
    return up.select(*by, F.col("p_level").alias("level"), *(F.col(f"p_{n}").alias(n) for n in index_names(dim)), F.col("pd").alias("depth"), *node, "value", F.col("oct"))


def propagate(own: DataFrame, subtrees: DataFrame, dim: int, max_level: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Fields of all subtrees by levels from the deepest to the root.

    own: the subtrees' generated values (key, depth, node, value). A parent's node is the mean of the coinciding
    children's values where they have any; a parent with all 2^dim children has nothing else; other parents keep
    their own values at nodes that no child covers. One pass for each level; levels are at most some twenty.
    A level is read by the result and by the next one, so it is written once. ``by``: fields, frames kept apart.
    """
    keys = [*by, *key_names(dim), "depth", *node_names(dim)]
    done = own.where(F.col("level") == max_level).select(*keys, "value")
    below = done
    for level in range(max_level - 1, -1, -1):
        up = to_parent(below, subtrees.where(F.col("level") == level), dim, by)
        mean = up.groupBy(*keys).agg(F.avg("value").alias("child"))
        key = [*by, *key_names(dim)]
        whole = up.groupBy(*key).agg(F.countDistinct("oct").alias("n")).where(F.col("n") == 1 << dim).select(*key, F.lit(True).alias("whole"))
        mine = own.where(F.col("level") == level).select(*keys, F.col("value").alias("own")).join(whole, key, "left").where("whole is null").drop("whole")
        below = keep(mean.join(mine, keys, "full_outer").select(*keys, F.coalesce("child", "own").alias("value")), "level")
        done = done.unionByName(below)
    return done


def boundary_field(points: DataFrame, blocks: DataFrame, subtrees: DataFrame, cube: Cube, max_level: int) -> DataFrame:
    """The signed distance to the boundary at the nodes of stored subtrees, scaled to [-1, 1] within each where it has both signs.

    points: boundary points (axes, unit normal n_*, size). A point counts, by its normal, at the corners of the blocks
    that hold it and the places one size before and behind it, each block once. Points of faces without a normal don't.
    """
    dim = cube.dim
    names = axes(dim)
    moved = points.where(reduce(lambda p, q: p | q, [F.col(f"n_{a}") != 0 for a in names]))
    moved = moved.select(*(F.col(a).alias(f"p_{a}") for a in names), *(f"n_{a}" for a in names), "size", F.monotonically_increasing_id().alias("point"))
    moved = keep(moved, "boundary").withColumn("_s", F.explode(F.array(*(F.lit(s) for s in (-1.0, 0.0, 1.0)))))
    moved = moved.select("*", *((F.col(f"p_{a}") + F.col("_s") * F.col("size") * F.col(f"n_{a}")).alias(a) for a in names))
    rows = deepest_block(cube_points(moved, cube), blocks, cube, max_level)
    rows = rows.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("level")))).withColumn("own", F.col("cut") == F.col("level"))
    place = [f"p_{a}" for a in names] + [f"n_{a}" for a in names]
    block = [right(F.col(n), F.col("level") - F.col("cut")).alias(f"b_{n}") for n in index_names(dim)]
    # of one point, a block counts once, whether it is the deepest for one of its places or cut for another
    once = rows.select("point", *place, "cut", *block, "own").groupBy("point", *place, "cut", *(f"b_{n}" for n in index_names(dim))).agg(F.max("own").alias("own"), F.min("own").alias("all_own"))
    once = once.withColumn("c", F.explode(corner_bits(dim)))
    size = cube.block_size(F.col("cut"))
    corner = [m + bit(F.col("c"), d) * size for d, m in enumerate(cube.block_min(F.col("cut"), [F.col(f"b_{n}") for n in index_names(dim)]))]
    distance = reduce(lambda p, q: p + q, [F.col(f"n_{a}") * (k - F.col(f"p_{a}")) for a, k in zip(names, corner, strict=True)])
    sums = once.groupBy("cut", "own", "all_own", *(f"b_{n}" for n in index_names(dim)), "c").agg(F.sum(distance).alias("vw"), F.count("*").alias("sw"))
    rows = _to_roots(sums, subtrees, dim)
    keys = [f"s_{k}" for k in key_names(dim)]
    total = rows.select(*keys, *_root_node(dim, F.col("cut"), [F.col(f"b_{n}") for n in index_names(dim)]), "vw", "sw").groupBy(*keys, *node_names(dim)).agg((F.sum("vw") / F.sum("sw")).alias("d"))
    total = total.select(*(F.col(k).alias(k.removeprefix("s_")) for k in keys), *node_names(dim), "d")
    return _scaled(total, key_names(dim), dim)


def _scaled(mean: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Distances d over the largest one of their sign in each group; as they are where there is one sign only."""
    span = mean.groupBy(*keys).agg(F.greatest(F.max("d"), F.lit(0.0)).alias("plus"), F.greatest(-F.min("d"), F.lit(0.0)).alias("minus"))
    both = (F.col("plus") > 0) & (F.col("minus") > 0)
    scaled = F.when(~both, F.col("d")).when(F.col("d") > 0, F.col("d") / F.col("plus")).otherwise(F.col("d") / F.col("minus"))
    return mean.join(span, keys).select(*keys, *node_names(dim), scaled.alias("value"))


def boundary_shape(faces: DataFrame, nodes: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Mean signed distance to boundary points near a node, scaled to [-1, 1] within each subtree where it has both signs.

    faces: subtree key, node, boundary point p_*, normal n_*; nodes: subtree key, node, axes.
    """
    near = faces.join(nodes, [*keys, *node_names(dim)])
    distance = reduce(lambda p, q: p + q, [F.col(f"n_{a}") * (F.col(a) - F.col(f"p_{a}")) for a in axes(dim)])
    return _scaled(near.groupBy(*keys, *node_names(dim)).agg(F.avg(distance).alias("d")), keys, dim)


def cube_points(points: DataFrame, cube: Cube, tol: float = 1e-6) -> DataFrame:
    """The points in the root cube, within a small tolerance."""
    keep = reduce(lambda p, q: p & q, [(F.col(a) >= m - tol * cube.size) & (F.col(a) <= m + cube.size * (1 + tol)) for a, m in zip(axes(cube.dim), cube.mins, strict=True)])
    return points.where(keep)
