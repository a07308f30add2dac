"""Orders and splits: reference arrangements, coverage, preconditions."""

import pytest
from pyspark.sql import functions as F

from octavo.functions import boxes
from octavo.operators import mesh, order


@pytest.mark.parametrize(("eye", "want"), [(-1, [6, 5, 4, 3, 2, 1, 0]), (0.01, [6, 5, 4, 3, 2, 1, 0]), (0.49, [0, 1, 2, 6, 5, 4, 3]), (0.99, [0, 1, 2, 3, 4, 5, 6]), (2, [0, 1, 2, 3, 4, 5, 6])])
def test_one_axis(spark, eye, want):
    cells = spark.range(7).select(F.col("id").cast("int").alias("x"))
    got = {r.x: r.number for r in order.back_to_front(cells, ["x"], 7, (eye,)).collect()}
    # the arrangement lists the number of each cell
    assert [got[i] for i in range(7)] == want


@pytest.mark.parametrize("eye", [(-1, -1), (0.1, 0.5), (0.5, 0.9), (2, 0.1), (0.49, 0.49)])
def test_far_cells_come_first(spark, eye):
    cells = mesh.odometer(spark, [5, 5], ["x", "y"])
    got = {(r.x, r.y): r.number for r in order.back_to_front(cells, ["x", "y"], 5, eye).collect()}
    assert sorted(got.values()) == list(range(25))
    at = [min(4, max(0, int(e * 5))) for e in eye]
    for (x, y), n in got.items():
        for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            near = (x + dx, y + dy)
            if near in got and abs(near[0] - at[0]) + abs(near[1] - at[1]) < abs(x - at[0]) + abs(y - at[1]):
                assert got[near] > n  # a nearer neighbour is drawn later


def test_uniform_split():
    assert order.split_uniform(0, 100, 101, 10, 20) == ((10, 10), None, (10, 20))
    assert order.split_uniform(100.11, 100, 101, 10, 20) == ((10, 11), 11, (12, 20))
    assert order.split_uniform(101.01, 100, 101, 10, 20) == ((10, 20), None, (20, 20))
    with pytest.raises(ValueError):
        order.split_uniform(0, 1, 0, 0, 1)
    with pytest.raises(ValueError):
        order.split_uniform(0, 0, 1, 2, 1)


def test_nonuniform_split():
    assert order.split_nonuniform(102.01, 100, 110, 5, [102, 105, 109]) == ((5, 6), 6, (7, 9))
    assert order.split_nonuniform(109.99, 100, 110, 5, [102, 105, 109]) == ((5, 8), 8, (9, 9))
    with pytest.raises(ValueError):
        order.split_nonuniform(1, 0, 9, 0, [5, 2])


@pytest.mark.parametrize(("level", "count"), [(0, 1), (1, 2), (2, 5), (3, 8), (3, 20), (4, 12), (4, 64), (5, 100)])
def test_cube_split_covers(level, count):
    split = order.split_cube(level, count)
    assert len(split) <= count
    assert sum((b[0] - a[0]) * (b[1] - a[1]) * (b[2] - a[2]) for a, b in split) == 8**level
    assert sorted(order.sorted_boxes(level, count, (0.3, 0.6, 2.0))) == sorted(split)
    todo = list(split)
    while len(todo) > 1:  # neighbours merge until one cube is left
        a = todo.pop()
        for b in todo:
            u = order.merged(a, b)
            if u:
                todo[todo.index(b)] = u
                break
        else:
            todo.insert(0, a)
    assert todo == [((0, 0, 0), (1 << level,) * 3)]


def test_padding_and_levels():
    assert len(order.padded(order.split_cube(1, 3), 7)) == 7
    assert order.sorted_levels([3, 1, 1, 2]) == [1, 2, 3]
    assert len(order.sorted_levels(list(range(99)))) == 50
    assert order.macro_order(3)[:8] == [0, 2, 6, 8, 18, 20, 24, 26] and order.macro_order(3)[-1] == 13
    assert order.worker_eye((0.0, 5.0)) == (0.5, 1.0)


def test_open_ranges(spark):
    r = spark.createDataFrame([(1, 1, 5, 2), (1, 3, 1, 3), (1, 3, 1, 4)], "a int, b int, c int, d int")
    got = [x[0] for x in r.select(boxes.range_equal((F.col("a"), F.col("b")), (F.col("c"), F.col("d")))).collect()]
    assert got == [True, True, False]
    assert r.where(boxes.in_range(F.lit(2), F.col("a"), F.col("b"))).count() == 2
