"""Axis-aligned boxes as (min, max) column lists, cubes and half-open ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from octavo.functions.vectors import Vec

Box = tuple[Vec, Vec]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda p, q: p & q, conditions)


def contains(box: Box, p: Vec, tol: float = 0.0) -> Column:
    return _all([(x >= lo - tol) & (x <= hi + tol) for lo, hi, x in zip(*box, p, strict=True)])


def intersects(a: Box, b: Box) -> Column:
    return _all([(al <= bh) & (bl <= ah) for al, ah, bl, bh in zip(*a, *b, strict=True)])


def intersection(a: Box, b: Box) -> Box:
    """The common box; empty where some min is above its max (see ``is_empty``)."""
    return [F.greatest(x, y) for x, y in zip(a[0], b[0], strict=True)], [F.least(x, y) for x, y in zip(a[1], b[1], strict=True)]


def is_empty(box: Box) -> Column:
    return ~_all([lo <= hi for lo, hi in zip(*box, strict=True)])


def inside(inner: Box, outer: Box) -> Column:
    return _all([(a >= lo) & (b <= hi) for a, b, lo, hi in zip(*inner, *outer, strict=True)])


def offset(box: Box, by: Vec) -> Box:
    return [x + d for x, d in zip(box[0], by, strict=True)], [x + d for x, d in zip(box[1], by, strict=True)]


def size_min_positive(box: Box) -> Column:
    """The smallest positive edge; null where there is none."""
    edges = [F.when(hi - lo > 0, hi - lo) for lo, hi in zip(*box, strict=True)]
    return F.least(*edges) if len(edges) > 1 else edges[0]


def size_max(box: Box) -> Column:
    edges = [hi - lo for lo, hi in zip(*box, strict=True)]
    return F.greatest(*edges) if len(edges) > 1 else edges[0]


def size_average(box: Box) -> Column:
    edges = [hi - lo for lo, hi in zip(*box, strict=True)]
    return reduce(lambda p, q: p + q, edges) / len(edges)


def element_size(box: Box) -> Column:
    """The largest edge; zero is an error."""
    size = size_max(box)
    return F.when(size > 0, size).otherwise(F.raise_error(F.lit("an element has no extent")))


def in_range(v: Column, a, b) -> Column:
    """Half-open [a, b)."""
    return (v >= a) & (v < b)


def range_empty(a: Column, b: Column) -> Column:
    return a >= b


def range_equal(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """All empty ranges are equal."""
    return (range_empty(*a) & range_empty(*b)) | ((a[0] == b[0]) & (a[1] == b[1]))


def clip_planes(p: Vec, planes: list[tuple[tuple[float, ...], tuple[float, ...]]]) -> Column:
    """Points that no plane (position, normal) hides: a plane hides the side its normal points to."""
    hidden = F.lit(False)
    for position, normal in planes:
        side = reduce(lambda a, b: a + b, [(x - q) * n for x, q, n in zip(p, position, normal, strict=True)])
        hidden = hidden | (side > 0)
    return ~hidden
