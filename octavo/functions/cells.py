"""Cells of the block tree: keys (level, ix, iy, iz), ordinals, Morton codes, positions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octavo.functions.vectors import Vec

AXES = ("x", "y", "z")


def axes(dim: int) -> tuple[str, ...]:
    return AXES[:dim]


def index_names(dim: int) -> list[str]:
    return [f"i{a}" for a in axes(dim)]


def node_names(dim: int) -> list[str]:
    return [f"n{a}" for a in axes(dim)]


def key_names(dim: int) -> list[str]:
    return ["level", *index_names(dim)]


def left(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x, F.lit(n) if isinstance(n, int) else n)


def right(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", x, F.lit(n) if isinstance(n, int) else n)


@dataclass(frozen=True)
class Cube:
    """The root cube: one row of the data's bounds, the only thing of the points that the driver sees."""

    mins: tuple[float, ...]
    size: float

    @property
    def dim(self) -> int:
        return len(self.mins)

    @staticmethod
    def around(mins: list[float], maxs: list[float]) -> Cube:
        """Centred on the box, with its largest edge."""
        edges = [b - a for a, b in zip(mins, maxs, strict=True)]
        size = max(edges)
        return Cube(tuple(a - size / 2 + e / 2 for a, e in zip(mins, edges, strict=True)), size)

    def unit(self, p: Vec) -> Vec:
        return [(x - F.lit(m)) / F.lit(self.size) for x, m in zip(p, self.mins, strict=True)]

    def cell(self, p: Vec, level: int) -> Vec:
        """The cell of a position: a point on a middle plane belongs below it."""
        n = 1 << level
        return [F.greatest(F.least(F.ceil(u * n) - 1, F.lit(n - 1)), F.lit(0)).cast("int") for u in self.unit(p)]

    def block_min(self, level: Column | int, index: Vec) -> Vec:
        return [F.lit(m) + i * self.block_size(level) for m, i in zip(self.mins, index, strict=True)]

    def block_size(self, level: Column | int) -> Column:
        return F.lit(self.size) / left(F.lit(1), level)

    def level_for(self, size: Column) -> Column:
        """The level whose blocks are nearest to a size in the logarithm."""
        return F.floor(F.log(F.lit(self.size) / size) / F.log(F.lit(2.0)) + 0.5).cast("int")


def bounds(points: DataFrame, dim: int) -> DataFrame:
    """One row: min and max along each axis."""
    return points.agg(*(f(a).alias(f"{n}_{a}") for a in axes(dim) for n, f in (("min", F.min), ("max", F.max))))


def cube_of(points: DataFrame, dim: int) -> Cube:
    row = bounds(points, dim).first()
    if row is None or row[0] is None:
        raise ValueError("no points")
    return Cube.around([row[f"min_{a}"] for a in axes(dim)], [row[f"max_{a}"] for a in axes(dim)])


def sufficient_depth(sizes: list[int]) -> int:
    """The least depth whose lattice covers an image of these sizes."""
    return max(0, (max(sizes) - 1).bit_length())


def image_block(index: Vec, depth: int, level: int) -> Vec:
    """The block at a level that holds a voxel of an image of that depth."""
    return [right(i, depth - level) if depth >= level else left(i, level - depth) for i in index]


def image_range(index: Column, level: Column | int, depth: int, size: int) -> tuple[Column, Column]:
    """Half-open voxel range of a block along one axis, cut to the image."""
    step = F.lit(depth) - (F.lit(level) if isinstance(level, int) else level)
    return F.least(left(index, step), F.lit(size)), F.least(left(index + 1, step), F.lit(size))


def image_position(index: Vec, mins: tuple[float, ...], voxel: float) -> Vec:
    """The centre of a voxel."""
    return [F.lit(m) + (i + 0.5) * voxel for i, m in zip(index, mins, strict=True)]


def vertices_per_edge(level: int) -> int:
    return (1 << level) + 1


def vertex_count(level: int, dim: int) -> int:
    return vertices_per_edge(level) ** dim


def block_count(level: int, dim: int) -> int:
    return 1 << (level * dim)


def ordinal(index: Vec, sizes: list[int]) -> Column:
    """Row-major number with the first axis fastest."""
    out, stride = F.lit(0).cast("long"), 1
    for i, n in zip(index, sizes, strict=True):
        out, stride = out + i.cast("long") * stride, stride * n
    return out


def from_ordinal(o: Column, sizes: list[int]) -> Vec:
    out = []
    for n in sizes:
        out.append((o % n).cast("int"))
        o = F.floor(o / n)
    return out


def block_ordinal(index: Vec, level: int) -> Column:
    return ordinal(index, [1 << level] * len(index))


def vertex_ordinal(index: Vec, level: int) -> Column:
    return ordinal(index, [vertices_per_edge(level)] * len(index))


def morton(index: Vec, bits: int) -> Column:
    """Interleaved bits, the first axis lowest."""
    dim = len(index)
    parts = [left(right(i, b).bitwiseAND(F.lit(1)).cast("long"), b * dim + d) for d, i in enumerate(index) for b in range(bits)]
    return reduce(lambda p, q: p.bitwiseOR(q), parts) if parts else F.lit(0).cast("long")


def octant(index: Vec) -> Column:
    """Which child of its parent a block is: bit d for axis d."""
    return reduce(lambda p, q: p + q, [left(i.bitwiseAND(F.lit(1)), d) for d, i in enumerate(index)])


def same_or_descendant(level: Column, index: Vec, root_level: Column, root_index: Vec) -> Column:
    below = level >= root_level
    up = F.greatest(level - root_level, F.lit(0))
    return reduce(lambda p, q: p & q, [below, *(right(i, up) == r for i, r in zip(index, root_index, strict=True))])


def corner_bits(dim: int) -> Column:
    """An array of the corners 0 .. 2^dim - 1; bit d of a corner is its side along axis d."""
    return F.array(*(F.lit(c) for c in range(1 << dim)))


def bit(corner: Column, d: int) -> Column:
    return right(corner, d).bitwiseAND(F.lit(1))


def pop_count_high(x: Column, bits: int, n: Column) -> Column:
    """Ones among the n highest of ``bits`` bits."""
    return F.bit_count(right(x, F.lit(bits) - n))


def find_interval(levels: Column, v: Column) -> Column:
    """How many of the sorted levels are at most v."""
    return F.size(F.filter(levels, lambda t: t <= v))
