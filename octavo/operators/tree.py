"""The block tree as a relation (level, ix, iy, iz): construction, lookup, subtrees.

Blocks are few compared with points: everything that walks up the tree starts from distinct cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octavo.functions.cells import Cube, axes, bit, corner_bits, index_names, key_names, left, morton, node_names, octant, right
from octavo.functions.prefix import rank_before, sum_before


def occupied(points: DataFrame, cube: Cube, level: int) -> DataFrame:
    """Cells with points at a level, and how many they hold."""
    cell = cube.cell([F.col(a) for a in axes(cube.dim)], level)
    return points.select(F.lit(level).alias("level"), *(c.alias(n) for c, n in zip(cell, index_names(cube.dim), strict=True))).groupBy(*key_names(cube.dim)).agg(F.count("*").alias("points"))


def ancestors(blocks: DataFrame, dim: int, include_self: bool = True, reach: int | None = None) -> DataFrame:
    """Each block's columns with those of every ancestor, or of those ``reach`` levels up, as (a_level, a_ix, ...)."""
    first = F.lit(0) if reach is None else F.greatest(F.col("level") - reach, F.lit(0))
    last = F.col("level") if include_self else F.col("level") - 1
    up = blocks.where("level > 0") if not include_self else blocks
    up = up.withColumn("a_level", F.explode(F.sequence(first, last)))
    return up.select("*", *(right(F.col(i), F.col("level") - F.col("a_level")).alias(f"a_{i}") for i in index_names(dim)))


def with_ancestors(cells: DataFrame, dim: int) -> DataFrame:
    """Blocks needed for these cells: the cells and all their ancestors."""
    cells = cells.select(*key_names(dim)).distinct()
    return ancestors(cells, dim).select(*(F.col(f"a_{k}").alias(k) for k in key_names(dim))).distinct()


def from_levels(points: DataFrame, cube: Cube, max_depth: int, size: str, coarser: int = 0) -> DataFrame:
    """Blocks for points with a size of their own: each at the level that suits its size, at most ``max_depth``, and ``coarser`` levels above that."""
    level = F.greatest(F.least(cube.level_for(F.col(size)), F.lit(max_depth)) - coarser, F.lit(0))
    n = left(F.lit(1).cast("long"), F.col("level"))
    rows = points.withColumn("level", level)
    cell = [F.greatest(F.least(F.ceil(u * n) - 1, n - 1), F.lit(0)).cast("int") for u in cube.unit([F.col(a) for a in axes(cube.dim)])]
    return with_ancestors(rows.select("level", *(c.alias(i) for c, i in zip(cell, index_names(cube.dim), strict=True))), cube.dim)


def around_boundary(points: DataFrame, cube: Cube, max_depth: int) -> DataFrame:
    """Refinement at boundary points (axes, normal n_*, size): blocks at p and p +- n * size / 2, one level coarser if above the root."""
    shifts = F.array(*(F.lit(s) for s in (0.0, 0.5, -0.5)))
    places = points.withColumn("_s", F.explode(shifts)).select("size", *((F.col(a) + F.col("_s") * F.col("size") * F.col(f"n_{a}")).alias(a) for a in axes(cube.dim)))
    return from_levels(places, cube, max_depth, "size", coarser=1)


def full_tree(spark: SparkSession, depth: int, dim: int) -> DataFrame:
    """All blocks down to a depth."""
    out = None
    for level in range(depth + 1):
        mask = (1 << level) - 1
        here = spark.range(1 << (level * dim)).select(F.lit(level).alias("level"), *(right(F.col("id"), level * d).bitwiseAND(F.lit(mask).cast("long")).cast("int").alias(n) for d, n in enumerate(index_names(dim))))
        out = here if out is None else out.unionByName(here)
    return out


def filled(blocks: DataFrame, min_depth: int, dim: int) -> DataFrame:
    """The tree with all blocks of at most ``min_depth``."""
    return blocks.select(*key_names(dim)).unionByName(full_tree(blocks.sparkSession, min_depth, dim)).distinct()


def child_masks(blocks: DataFrame, dim: int) -> DataFrame:
    """Which children each block has: one bit per child, the first child the highest; 0 for leaves."""
    index = [F.col(i) for i in index_names(dim)]
    child = left(F.lit(1), F.lit((1 << dim) - 1) - octant(index))
    parents = blocks.where("level > 0").select((F.col("level") - 1).alias("level"), *(right(i, 1).alias(n) for i, n in zip(index, index_names(dim), strict=True)), child.alias("m"))
    masks = parents.groupBy(*key_names(dim)).agg(F.bit_or("m").alias("mask"))
    return blocks.select(*key_names(dim)).join(masks, key_names(dim), "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def from_masks(masks: DataFrame, dim: int) -> DataFrame:
    """The blocks again, from child masks: the root and every child marked."""
    octants = F.filter(corner_bits(dim), lambda c: F.bit_count(F.col("mask").bitwiseAND(left(F.lit(1), F.lit((1 << dim) - 1) - c))) > 0)
    children = masks.select("*", F.explode(octants).alias("c")).select((F.col("level") + 1).alias("level"), *((left(F.col(n), 1) + bit(F.col("c"), d)).alias(n) for d, n in enumerate(index_names(dim))))
    return masks.where("level = 0").select(*key_names(dim)).unionByName(children)


def numbered(blocks: DataFrame, dim: int, depth: int) -> DataFrame:
    """Breadth-first numbers: by level, then by path of octants. ``depth`` bounds the levels."""
    path = morton([F.col(i) for i in index_names(dim)], depth)
    rows = blocks.withColumn("path", path)
    chunk = F.col("level").cast("long") * (1 << 40) + right(F.col("path"), F.lit(12))
    return rank_before(rows, [], chunk, [F.col("path")], "number").drop("path")


def rank_index(masks: DataFrame, dim: int, depth: int) -> DataFrame:
    """For each block its number and its first child's: 1 + the children of all blocks before it (null for leaves)."""
    rows = numbered(masks, dim, depth).withColumn("children", F.bit_count("mask").cast("long"))
    rows = sum_before(rows, [], F.floor(F.col("number") / 4096), [F.col("number")], F.col("children"), "earlier")
    return rows.withColumn("first_child", F.when(F.col("children") > 0, F.col("earlier") + 1)).drop("earlier")


def block_at(keys: DataFrame, blocks: DataFrame, dim: int, strict: bool = True) -> DataFrame:
    """Exact lookup; a key without a block is an error, or has a false ``found`` if not ``strict``."""
    marked = blocks.withColumn("_found", F.lit(True))
    out = keys.join(marked, key_names(dim), "left")
    if not strict:
        return out.withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")
    return out.where(F.when(F.col("_found"), True).otherwise(F.raise_error(F.lit("no such block")))).drop("_found")


#: Levels whose blocks are few by their nature: (8 ** 5 - 1) / 7 in space at most.
TOP = 4


def under(up: DataFrame, blocks: DataFrame, dim: int) -> DataFrame:
    """Rows with an ancestor (a_level, a_ix, ...) joined to the blocks that it is. Every row has the same few ancestors
    at the top; these are broadcast, as they are at most 4,681."""
    keys = [f"a_{k}" for k in key_names(dim)]
    named = blocks.withColumnsRenamed(dict(zip(key_names(dim), keys, strict=True)))
    high = up.where(F.col("a_level") <= TOP).join(F.broadcast(named.where(F.col("a_level") <= TOP)), keys)
    return high.unionByName(up.where(F.col("a_level") > TOP).join(named.where(F.col("a_level") > TOP), keys))


def deepest_block(points: DataFrame, blocks: DataFrame, cube: Cube, max_level: int) -> DataFrame:
    """Each point with the deepest existing block that holds it, down to ``max_level``."""
    dim = cube.dim
    cell = cube.cell([F.col(a) for a in axes(dim)], max_level)
    located = points.select("*", *(c.alias(f"c_{n}") for c, n in zip(cell, index_names(dim), strict=True)))
    cells = located.select(F.lit(max_level).alias("level"), *(F.col(f"c_{n}").alias(n) for n in index_names(dim))).distinct()
    found = under(ancestors(cells, dim), blocks.select(*key_names(dim)), dim)
    best = found.groupBy(*index_names(dim)).agg(F.max("a_level").alias("level"))
    best = best.select(*(F.col(n).alias(f"c_{n}") for n in index_names(dim)), "level")
    out = located.join(best, [f"c_{n}" for n in index_names(dim)])
    names = [c for c in points.columns]
    return out.select(*names, "level", *(right(F.col(f"c_{n}"), F.lit(max_level) - F.col("level")).alias(n) for n in index_names(dim)))


def heights(blocks: DataFrame, dim: int) -> DataFrame:
    """How far each block's subtree reaches below it."""
    up = ancestors(blocks.select(*key_names(dim)), dim)
    return up.groupBy(*(F.col(f"a_{k}").alias(k) for k in key_names(dim))).agg((F.max("level") - F.first("a_level")).cast("int").alias("height"))


def walk(blocks: DataFrame, root: tuple[int, ...], dim: int, depth: int | None = None) -> DataFrame:
    """The root's descendants (itself too), at most ``depth`` levels below it."""
    level, *index = root
    rows = blocks.where(F.col("level") >= level)
    for n, i in zip(index_names(dim), index, strict=True):
        rows = rows.where(right(F.col(n), F.col("level") - level) == i)
    return rows if depth is None else rows.where(F.col("level") <= level + depth)


def is_deeper(blocks: DataFrame, root: tuple[int, ...], dim: int, depth: int) -> DataFrame:
    """One row: whether a walk of so many levels from the root leaves out blocks below."""
    return walk(blocks, root, dim).agg(F.coalesce(F.max(F.col("level") > root[0] + depth), F.lit(False)).alias("deeper"))


def child_counts(blocks: DataFrame, dim: int) -> DataFrame:
    """Blocks with their number of children and whether they have all, none or a part of them."""
    n = F.bit_count("mask").cast("int")
    return child_masks(blocks, dim).select(*key_names(dim), n.alias("children"), (n == 1 << dim).alias("has_all"), (n == 0).alias("has_none"), ((n > 0) & (n < 1 << dim)).alias("has_part"))


def storage_subtrees(blocks: DataFrame, dim: int, full_level: int, depth: int) -> DataFrame:
    """Roots of the stored subtrees, with their depth: all blocks down to ``full_level`` and those whose subtree is as deep as the unit."""
    tall = heights(blocks, dim).where((F.col("level") <= full_level) | (F.col("height") >= depth))
    return tall.select(*key_names(dim), F.least("height", F.lit(depth)).alias("depth"))


def closest_subtree(blocks: DataFrame, subtrees: DataFrame, dim: int) -> DataFrame:
    """Each block with the deepest stored subtree root at or above it (s_level, s_ix, ...)."""
    keys = key_names(dim)
    found = under(ancestors(blocks.select(*keys), dim), subtrees.select(*keys), dim)
    best = found.groupBy(*keys).agg(F.max("a_level").alias("s_level"))
    return best.select(*keys, "s_level", *(right(F.col(n), F.col("level") - F.col("s_level")).alias(f"s_{n}") for n in index_names(dim)))


def subtree_members(subtrees: DataFrame, blocks: DataFrame, dim: int) -> DataFrame:
    """(subtree key, depth, b_level, b_ix, ...): the blocks of each subtree within its depth.

    A block meets the roots up to the largest depth above it only, so a root's rows are bounded by its lattice.
    """
    keys = key_names(dim)
    reach = subtrees.agg(F.max("depth")).first()[0] or 0
    up = ancestors(blocks.select(*keys), dim, reach=reach).select(*(F.col(k).alias(f"b_{k}") for k in keys), *(F.col(f"a_{k}").alias(k) for k in keys))
    return up.join(subtrees.select(*keys, "depth"), keys).where(F.col("b_level") - F.col("level") <= F.col("depth"))


def corner_index(dim: int) -> list:
    """Columns of a corner ``c`` of block b_* in units of its subtree's finest blocks."""
    shift = F.col("depth") - (F.col("b_level") - F.col("level"))
    mask = left(F.lit(1), F.col("depth")) - 1
    return [(left(F.col(f"b_{n}"), shift).bitwiseAND(mask) + left(bit(F.col("c"), d), shift)).alias(m) for d, (n, m) in enumerate(zip(index_names(dim), node_names(dim), strict=True))]


def subtree_nodes(subtrees: DataFrame, blocks: DataFrame, dim: int) -> DataFrame:
    """The distinct block corners of each subtree."""
    members = subtree_members(subtrees, blocks, dim).withColumn("c", F.explode(corner_bits(dim)))
    return members.select(*key_names(dim), "depth", *corner_index(dim)).distinct()


def metadata(subtrees: DataFrame, blocks: DataFrame, dim: int, tree_depth: int, value_bytes: int = 4) -> DataFrame:
    """Per subtree: depth, nodes, share of its lattice that is filled, and the offset of its values in pre-order."""
    keys = key_names(dim)
    counts = subtree_nodes(subtrees, blocks, dim).groupBy(*keys).agg(F.count("*").alias("node_count"))
    rows = subtrees.join(counts, keys)
    path = left(morton([F.col(i) for i in index_names(dim)], tree_depth), (F.lit(tree_depth) - F.col("level")) * dim)
    rows = rows.withColumn("path", path)
    rows = sum_before(rows, [], right(F.col("path"), F.lit(max(0, tree_depth * dim - 8))), [F.col("path"), F.col("level")], (F.col("node_count") + 2) * value_bytes, "values_pos")
    lattice = F.pow((left(F.lit(1), F.col("depth")) + 1).cast("double"), F.lit(dim))
    return rows.select(*keys, "depth", "node_count", "values_pos", F.round(F.col("node_count") / lattice, 6).alias("fill"))


def deepest_neighbour(blocks: DataFrame, dim: int, depth: int) -> DataFrame:
    """Per block corner of the tree: the deepest level that touches it, and the first corner slot that has it."""
    rows = blocks.withColumn("c", F.explode(corner_bits(dim)))
    node = [left(F.col(n) + bit(F.col("c"), d), F.lit(depth) - F.col("level")).alias(m) for d, (n, m) in enumerate(zip(index_names(dim), node_names(dim), strict=True))]
    slots = rows.select(*node, "c", "level").groupBy(*node_names(dim), "c").agg(F.max("level").alias("level"))
    best = slots.groupBy(*node_names(dim)).agg(F.max(F.struct("level", (-F.col("c")).alias("m"))).alias("b"))
    return best.select(*node_names(dim), F.col("b.level").alias("deepest"), (-F.col("b.m")).alias("slot"))


def levels(subtrees: DataFrame) -> DataFrame:
    return subtrees.groupBy("level").agg(F.count("*").alias("blocks"), F.max("depth").alias("depth")).orderBy("level")


def exact_depth(size: float, min_cell: float, max_depth: int) -> int:
    """The depth at which blocks are as small as the cells of an analytic problem."""
    import math

    return max(0, min(max_depth, int(math.ceil(math.log2(size / min_cell)) + 0.1)))


def in_order(blocks: DataFrame, dim: int, tree_depth: int) -> DataFrame:
    """Pre-order: parents before children, children by octant."""
    path = left(morton([F.col(i) for i in index_names(dim)], tree_depth), (F.lit(tree_depth) - F.col("level")) * dim)
    return blocks.orderBy(path, "level")


def index_lookup(nodes: DataFrame, dim: int) -> DataFrame:
    """Node numbers within each subtree, by lattice order."""
    w = Window.partitionBy(*key_names(dim)).orderBy(*reversed(node_names(dim)))
    return nodes.withColumn("node", F.row_number().over(w) - 1)
