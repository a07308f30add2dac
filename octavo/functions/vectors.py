"""Vectors and index vectors as one column per axis: every function maps lists of columns to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = list[Column]


def add(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b, strict=True)]


def sub(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b, strict=True)]


def mul(a: Vec, b: Vec) -> Vec:
    return [x * y for x, y in zip(a, b, strict=True)]


def div(a: Vec, b: Vec) -> Vec:
    """Element-wise quotient, null where the divisor is 0."""
    return [F.try_divide(x, y) for x, y in zip(a, b, strict=True)]


def scale(a: Vec, k: float | Column) -> Vec:
    return [x * k for x in a]


def dot(a: Vec, b: Vec) -> Column:
    return reduce(lambda p, q: p + q, mul(a, b))


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def cross2(a: Vec, b: Vec) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def rotate_cw(a: Vec) -> Vec:
    return [a[1], -a[0]]


def rotate_ccw(a: Vec) -> Vec:
    return [-a[1], a[0]]


def norm2_squared(a: Vec) -> Column:
    return dot(a, a)


def norm2(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def norm1(a: Vec) -> Column:
    return reduce(lambda p, q: p + q, [F.abs(x) for x in a])


def norm_inf(a: Vec) -> Column:
    """The largest absolute component."""
    return F.greatest(*[F.abs(x) for x in a]) if len(a) > 1 else F.abs(a[0])


def primary_axis(a: Vec) -> Column:
    """The first axis with the largest absolute component."""
    top = norm_inf(a)
    out = F.lit(len(a) - 1)
    for d in range(len(a) - 2, -1, -1):
        out = F.when(F.abs(a[d]) == top, F.lit(d)).otherwise(out)
    return out


def orientation(a: Vec) -> Column:
    """+1 or -1: the sign of the primary component (0 counts as +)."""
    axis = primary_axis(a)
    out = a[-1]
    for d in range(len(a) - 2, -1, -1):
        out = F.when(axis == d, a[d]).otherwise(out)
    return F.when(out < 0, -1).otherwise(1)


def shift_left(a: Vec, n: int | Column) -> Vec:
    return [F.call_function("shiftleft", x, F.lit(n) if isinstance(n, int) else n) for x in a]


def shift_right(a: Vec, n: int | Column) -> Vec:
    return [F.call_function("shiftright", x, F.lit(n) if isinstance(n, int) else n) for x in a]


def bit_and(a: Vec, n: int) -> Vec:
    return [x.bitwiseAND(F.lit(n)) for x in a]


def bit_or(a: Vec, n: int) -> Vec:
    return [x.bitwiseOR(F.lit(n)) for x in a]


def signed_shift_right(x: Column, n: Column) -> Column:
    """Right by n, or left by -n where n is negative."""
    right = F.call_function("shiftright", x, F.greatest(n, F.lit(0)))
    return F.when(n >= 0, right).otherwise(F.call_function("shiftleft", x, F.greatest(-n, F.lit(0))))


def compare_all(a: Vec, b: Vec, op) -> Column:
    return reduce(lambda p, q: p & q, [op(x, y) for x, y in zip(a, b, strict=True)])


def compare_some(a: Vec, b: Vec, op) -> Column:
    return reduce(lambda p, q: p | q, [op(x, y) for x, y in zip(a, b, strict=True)])


def is_zero(a: Vec) -> Column:
    return reduce(lambda p, q: p & q, [x == 0 for x in a])


def clamp(x: Column, lo, hi) -> Column:
    lo, hi = (F.lit(v) if not isinstance(v, Column) else v for v in (lo, hi))
    return F.greatest(lo, F.least(x, hi))


def solve2(m: list[Vec], b: Vec) -> Vec:
    """Cramer's rule for 2 x 2 (rows of m); null where singular."""
    det = m[0][0] * m[1][1] - m[0][1] * m[1][0]
    return [F.try_divide(b[0] * m[1][1] - m[0][1] * b[1], det), F.try_divide(m[0][0] * b[1] - b[0] * m[1][0], det)]


def det3(m: list[Vec]) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def solve3(m: list[Vec], b: Vec) -> Vec:
    """Cramer's rule for 3 x 3; null where singular."""
    det = det3(m)
    out = []
    for d in range(3):
        out.append(F.try_divide(det3([[b[r] if c == d else m[r][c] for c in range(3)] for r in range(3)]), det))
    return out


def invert2(m: list[Vec]) -> list[Vec]:
    det = m[0][0] * m[1][1] - m[0][1] * m[1][0]
    return [[F.try_divide(m[1][1], det), F.try_divide(-m[0][1], det)], [F.try_divide(-m[1][0], det), F.try_divide(m[0][0], det)]]


def invert3(m: list[Vec]) -> list[Vec]:
    unit = [[F.lit(1.0 if r == c else 0.0) for r in range(3)] for c in range(3)]
    columns = [solve3(m, e) for e in unit]
    return [[columns[c][r] for c in range(3)] for r in range(3)]


def triangle_barycentric(p: Vec, a: Vec, b: Vec, c: Vec) -> Vec:
    """Weights of b and c at point p in the plane (a's is 1 less both); inside iff all three are at least 0."""
    u, v, w = sub(b, a), sub(c, a), sub(p, a)
    return solve2([[u[0], v[0]], [u[1], v[1]]], w)


def tetrahedron_barycentric(p: Vec, a: Vec, b: Vec, c: Vec, d: Vec) -> Vec:
    u, v, t, w = sub(b, a), sub(c, a), sub(d, a), sub(p, a)
    return solve3([[u[r], v[r], t[r]] for r in range(3)], w)


def simplex_inside(weights: Vec) -> Column:
    rest = F.lit(1.0) - reduce(lambda p, q: p + q, weights)
    return reduce(lambda p, q: p & q, [x >= 0 for x in [*weights, rest]])


def simplex_interpolate(weights: Vec, values: Vec) -> Column:
    rest = F.lit(1.0) - reduce(lambda p, q: p + q, weights)
    return dot([rest, *weights], values)


def face_normal(points: list[Vec]) -> Vec:
    """Unit normal of a segment (2-D) or of a triangle or quad (3-D); zero for degenerate ones."""
    if len(points) == 2:
        n = rotate_cw(sub(points[1], points[0]))
    elif len(points) == 3:
        n = cross(sub(points[1], points[0]), sub(points[2], points[0]))
    else:
        n = cross(sub(points[2], points[0]), sub(points[3], points[1]))
    length = norm2(n)
    return [F.coalesce(F.try_divide(x, length), F.lit(0.0)) for x in n]
