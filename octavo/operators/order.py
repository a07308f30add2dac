"""Back-to-front order, range splits and index-cube splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def macro_order(dim: int) -> list[int]:
    """The order of macro cells, by code (one digit 0 before the eye, 1 at it, 2 after in base 3 for each axis, x lowest):
    corners, then edges, then faces, then the cell at the eye, each kind in ascending code."""
    ones = lambda c: sum(c // 3**d % 3 == 1 for d in range(dim))
    return sorted(range(3**dim), key=lambda c: (ones(c), c))


def split_uniform(x: float, lo: float, hi: float, start: int, stop: int) -> tuple[tuple[int, int], int | None, tuple[int, int]]:
    """(before, at, after) of index range [start, stop) spread evenly over [lo, hi)."""
    if stop < start or hi < lo:
        raise ValueError("reversed range")
    if x <= lo:
        return (start, start), None, (start, stop)
    if x >= hi:
        return (start, stop), None, (stop, stop)
    at = int((x - lo) * (stop - start) / (hi - lo)) + start
    return (start, at), at, (at + 1, stop)


def split_nonuniform(x: float, lo: float, hi: float, start: int, cuts: list[float]) -> tuple[tuple[int, int], int | None, tuple[int, int]]:
    """The same with given inner cuts: len(cuts) + 1 indices from ``start`` on."""
    if hi < lo or cuts != sorted(cuts):
        raise ValueError("cuts must ascend")
    stop = start + len(cuts) + 1
    if x <= lo:
        return (start, start), None, (start, stop)
    if x >= hi:
        return (start, stop), None, (stop, stop)
    at = start + sum(c < x for c in cuts)
    return (start, at), at, (at + 1, stop)


def split_columns(x: Column, lo: float, hi: float, start: int, stop: int) -> dict[str, Column]:
    """``split_uniform`` for a column: before_end, at (null outside), after_start."""
    at = F.floor((x - lo) * (stop - start) / (hi - lo)).cast("int") + start
    inner = (x > lo) & (x < hi)
    return {
        "before_end": F.when(x <= lo, start).when(x >= hi, stop).otherwise(at),
        "at_index": F.when(inner, at),
        "after_start": F.when(x <= lo, start).when(x >= hi, stop).otherwise(at + 1),
    }


def split_cut_columns(x: Column, lo: float, hi: float, start: int, cuts: list[float]) -> dict[str, Column]:
    """``split_nonuniform`` for a column."""
    stop = start + len(cuts) + 1
    at = F.lit(start)
    for c in cuts:
        at = at + F.when(x > c, 1).otherwise(0)
    inner = (x > lo) & (x < hi)
    return {
        "before_end": F.when(x <= lo, start).when(x >= hi, stop).otherwise(at),
        "at_index": F.when(inner, at),
        "after_start": F.when(x <= lo, start).when(x >= hi, stop).otherwise(at + 1),
    }


def order_key(index: list[Column], size: int | list[int], eye: tuple[float, ...], lo: float | tuple[float, ...] = 0.0, hi: float | tuple[float, ...] = 1.0) -> list[Column]:
    """Sort key of cells so that none comes before one that it hides from the eye.

    Cells of an axis lie before, at or after the eye; macro cells come in a fixed order, and inside one the cells
    by their coordinate sum, the axes after the eye mirrored.
    """
    dim = len(index)
    sizes = [size] * dim if isinstance(size, int) else size
    lows = (lo,) * dim if not isinstance(lo, tuple) else lo
    highs = (hi,) * dim if not isinstance(hi, tuple) else hi
    digits, places = [], []
    for i, n, e, a, b in zip(index, sizes, eye, lows, highs, strict=True):
        before, at, after = split_uniform(e, a, b, 0, n)
        digit = F.when(i < before[1], 0).when(i >= after[0], 2).otherwise(1)
        digits.append(digit)
        places.append(F.when(digit == 0, i - before[0]).when(digit == 2, F.lit(after[1] - 1) - i).otherwise(0))
    code = digits[0]
    for d in range(1, dim):
        code = code + digits[d] * 3**d
    rank = F.element_at(F.array(*(F.lit(macro_order(dim).index(c)) for c in range(3**dim))), code + 1)
    total = places[0]
    for p in places[1:]:
        total = total + p
    return [rank, total, *([places[2]] if dim == 3 else []), *([places[1]] if dim > 1 else [])]


def back_to_front(cells: DataFrame, names: list[str], size: int, eye: tuple[float, ...]) -> DataFrame:
    """Cells in order, with their number: far ones first."""
    from octavo.functions.prefix import rank_before

    key = order_key([F.col(n) for n in names], size, eye)
    rows = cells.select("*", *(k.alias(f"_o{i}") for i, k in enumerate(key)))
    order = [F.col(f"_o{i}") for i in range(len(key))]
    chunk = order[0].cast("long") * (1 << 32) + (order[1] if len(key) > 1 else F.lit(0))
    return rank_before(rows, [], chunk, order, "number").drop(*(f"_o{i}" for i in range(len(key))))


def split_cube(level: int, count: int) -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """The index cube of a level as at most ``count`` boxes (min, max exclusive), cut along x first, then y, z."""
    n = 1 << level
    left = min(n**3, count)
    per_axis = []
    for _ in range(3):
        k = min(left, n)
        per_axis.append(k)
        left = max(1, left // n)
    edges = [[i * n // k for i in range(k + 1)] for k in per_axis]
    boxes = []
    for z in range(per_axis[2]):
        for y in range(per_axis[1]):
            for x in range(per_axis[0]):
                at = (x, y, z)
                boxes.append((tuple(edges[d][at[d]] for d in range(3)), tuple(edges[d][at[d] + 1] for d in range(3))))
    return boxes


def padded(boxes: list, count: int) -> list:
    """Boxes with empty ones added, up to a number."""
    empty = ((0, 0, 0), (0, 0, 0))
    return [*boxes, *([empty] * max(0, count - len(boxes)))]


def sorted_boxes(level: int, count: int, eye: tuple[float, float, float]) -> list:
    """The split cube's boxes back to front: by the order of their own grid."""
    boxes = split_cube(level, count)
    n = [len({b[0][d] for b in boxes}) for d in range(3)]
    firsts = [sorted({b[0][d] for b in boxes}) for d in range(3)]
    size = 1 << level

    def key(box):
        digits, places = [], []
        for d in range(3):
            i = firsts[d].index(box[0][d])
            _, at, after = split_nonuniform(eye[d], 0.0, 1.0, 0, [f / size for f in firsts[d][1:]])
            digit = 1 if i == at else 2 if i >= after[0] and eye[d] < 1 else 0
            digits.append(digit)
            places.append(i if digit == 0 else n[d] - 1 - i if digit == 2 else 0)
        rank = macro_order(3).index(sum(x * 3**d for d, x in enumerate(digits)))
        return rank, sum(places), places[2], places[1]

    return sorted(boxes, key=key)


def merged(a, b):
    """The union of two boxes that share a whole face, else None."""
    same = [d for d in range(3) if a[0][d] == b[0][d] and a[1][d] == b[1][d]]
    if len(same) == 3:
        return a
    if len(same) == 2:
        d = ({0, 1, 2} - set(same)).pop()
        if a[1][d] == b[0][d] or b[1][d] == a[0][d]:
            return tuple(min(x, y) for x, y in zip(a[0], b[0], strict=True)), tuple(max(x, y) for x, y in zip(a[1], b[1], strict=True))
    return None


def worker_eye(eye: tuple[float, ...], half: float = 5.0) -> tuple[float, ...]:
    """An eye in [-half, half] per axis as a place in the unit cube."""
    return tuple((e + half) / (2 * half) for e in eye)


def index_box_bounds(level: int, lo: tuple[int, ...], hi: tuple[int, ...], half: float = 5.0) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The place of an index box (hi exclusive) of a level in the cube [-half, half]."""
    size = 2 * half / (1 << level)
    return tuple(size * i - half for i in lo), tuple(size * i - half for i in hi)


def sorted_levels(levels: list[float], most: int = 50) -> list[float]:
    """Distinct levels in order, at most so many."""
    return sorted(set(levels))[:most]


def sorted_level_column(levels: Column, most: int = 50) -> Column:
    return F.slice(F.array_sort(F.array_distinct(levels)), 1, most)
