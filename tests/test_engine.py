"""Invariants of trees, fields, interpolation, dense fill, views and state."""

import shutil
import tempfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from octavo.functions import boxes, cells, colors, vectors
from octavo.functions.cells import Cube, cube_of
from octavo.operators import dense, fields, interpolate, mesh, telemetry, tree, view
from octavo.plans import prepare
from octavo.plans import view as plan
from octavo.plans.adapters import rounded
from octavo.streaming import stateful


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.random((400, 3)) ** 2)], "id long, x double, y double, z double").withColumn("one", F.lit(7.0))


def test_cells_equal_repeated_halving(spark):
    cube = Cube((0.0,), 64.0)
    rows = spark.createDataFrame([(float(x) / 4,) for x in range(257)], "x double").select("x", cube.cell([F.col("x")], 6)[0].alias("c")).collect()
    for r in rows:
        lo, size, c = 0.0, 64.0, 0
        for _ in range(6):
            size /= 2
            up = r.x > lo + size
            c, lo = 2 * c + up, lo + size * up
        assert r.c == c


def test_every_parent_exists(points):
    cube = cube_of(points, 3)
    blocks = tree.with_ancestors(tree.occupied(points, cube, 4), 3)
    have = {tuple(r) for r in blocks.collect()}
    assert all(l == 0 or (l - 1, x >> 1, y >> 1, z >> 1) in have for l, x, y, z in have)
    back = tree.from_masks(tree.child_masks(blocks, 3), 3)
    assert {tuple(r) for r in back.collect()} == have
    ranked = {tuple(r)[:4]: (r.number, r.first_child) for r in tree.rank_index(tree.child_masks(blocks, 3), 3, 4).collect()}
    assert sorted(n for n, _ in ranked.values()) == list(range(len(have)))
    for (l, x, y, z), (_, first) in ranked.items():
        if first is not None:
            assert first == min(ranked[k][0] for k in have if k[0] == l + 1 and (k[1] >> 1, k[2] >> 1, k[3] >> 1) == (x, y, z))
    assert [r.level for r in tree.in_order(blocks, 3, 4).limit(2).collect()] == [0, 1]
    with pytest.raises(Exception, match="no such block"):
        tree.block_at(blocks.limit(1).withColumn("ix", F.lit(99)), blocks, 3).collect()


@pytest.mark.parametrize(("full", "depth"), [(0, 1), (0, 2), (1, 2), (2, 3)])
def test_stored_subtrees_by_the_recursive_rule(points, full, depth):
    cube = cube_of(points, 3)
    blocks = tree.filled(tree.with_ancestors(tree.occupied(points, cube, 4), 3), full, 3)
    have = {tuple(r) for r in blocks.collect()}
    kids = lambda b: [k for k in have if k[0] == b[0] + 1 and tuple(i >> 1 for i in k[1:]) == b[1:]]
    height = {}

    def measure(b):
        height[b] = max([1 + measure(k) for k in kids(b)], default=0)
        return height[b]

    measure((0, 0, 0, 0))
    want = {}

    def visit(b, m):
        want[b] = min(height[b], depth)
        if m > 0 or height[b] > depth:
            for k in kids(b):
                if m > 0 or height[k] > depth - 1:
                    visit(k, max(m - 1, 0))

    visit((0, 0, 0, 0), full)
    assert {tuple(r)[:4]: r.depth for r in tree.storage_subtrees(blocks, 3, full, depth).collect()} == want


def test_constant_fields_stay_constant(points):
    made = prepare.points_problem(points, 3, "one", 3, 2)
    assert made.sparse.where("abs(value - 7) > 1e-9").count() == 0 and made.sparse.count() > 0
    two = prepare.generated(made, lambda made, field, frame: tree.subtree_nodes(made.subtrees, made.blocks, 3).withColumn("value", F.lit(2.0 + frame)), "p", 1, 3)
    assert {r.value for r in two.select("value").distinct().collect()} == {3.0} and two.count() >= made.sparse.count()
    mean = fields.corner_mean(points, made.cube, 3, "x").collect()
    assert all(-1e-9 <= r.value <= 1 + 1e-9 for r in mean)


def test_boundary_of_shapes(spark):
    for n in (2, 3):
        assert mesh.boundary_faces(mesh.structured_elements(spark, [n + 1] * 3)).count() == 6 * n * n
    rows = [(0, 0, "hexahedron", [0, 1, 2, 3, 4, None, None, None]), (0, 1, "hexahedron", [10, 11, 12, 13, 14, 15, None, None]), (0, 2, "hexahedron", [20, 21, 22, 23, None, None, None, None]), (0, 3, "hexahedron", list(range(30, 38)))]
    e = spark.createDataFrame(rows, "zone_id int, element_id long, etype string, nodes array<long>")
    assert [r.subtype for r in mesh.with_subtype(e).orderBy("element_id").collect()] == ["pyramid", "prism", "tetrahedron", "hexahedron"]
    assert {r.element_id: r.n for r in mesh.faces(e).groupBy("element_id").agg(F.count("*").alias("n")).collect()} == {0: 5, 1: 5, 2: 4, 3: 6}
    assert {r.element_id: r.n for r in mesh.simplices(e).groupBy("element_id").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 3, 2: 1, 3: 5}
    assert all(None not in r.nodes for r in mesh.completed(e).collect())
    assert mesh.checked(e, 3).count() == 4
    with pytest.raises(Exception, match="does not fit"):
        mesh.checked(e, 2).collect()
    f = mesh.boundary_faces(e)
    assert mesh.renumbered(f, mesh.boundary_nodes(f)).count() == f.count() == 20
    assert len(mesh.sub_faces(3)) == 12 + 6 + 1 and len(mesh.sub_faces(2)) == 4 + 1


def test_boundary_points_point_outward(spark):
    n = 3
    nodes = mesh.odometer(spark, [n] * 3, ["i", "j", "k"]).select(F.lit(0).alias("zone_id"), F.col("id").alias("node_id"), *(F.col(c).cast("double").alias(a) for c, a in zip("ijk", "xyz", strict=True)))
    e = mesh.structured_elements(spark, [n] * 3)
    p = mesh.boundary_points(mesh.boundary_faces(e), nodes, 3, 2).collect()
    assert p and all(sum((c - 1) * m for c, m in ((r.x, r.n_x), (r.y, r.n_y), (r.z, r.n_z))) > 0 for r in p)
    grown = mesh.inflated(cells.bounds(nodes, 3), mesh.boundary_points(mesh.boundary_faces(e), nodes, 3), 3).first()
    assert grown.min_x == -1 and grown.max_z == 3


def test_newton_inverts_hexahedra():
    rng = np.random.default_rng(2)
    for dim in (2, 3):
        base = np.array([[c >> d & 1 for d in range(dim)] for c in range(1 << dim)], float)
        corners = np.repeat(base[None], 300, 0) + rng.normal(0, 0.08, (300, 1 << dim, dim))
        xi = rng.uniform(-1.6, 1.6, (300, dim))
        signs = base * 2 - 1
        shape = np.prod(1 + signs[None] * xi[:, None, :], axis=2) / (1 << dim)
        p = np.einsum("nc,nca->na", shape, corners)
        got, inside, good = interpolate.inverse_map(p, corners)
        want = (np.abs(xi) <= 1).all(1)
        clear = (np.abs(np.abs(xi) - 1) > 0.01).all(1) & (np.abs(xi) < 1.5).all(1)
        assert (inside == want)[clear].mean() > 0.99 and good.mean() > 0.97
        assert np.allclose(got[want], xi[want], atol=1e-2)


def test_linear_fields_interpolate_exactly(spark, tmp_path):
    n = 5
    nodes = mesh.odometer(spark, [n] * 3, ["i", "j", "k"]).select(F.lit(0).alias("zone_id"), F.col("id").alias("node_id"), *(F.col(c).cast("double").alias(a) for c, a in zip("ijk", "xyz", strict=True)))
    nodes = nodes.withColumn("v", F.col("x") + 2 * F.col("y") + 3 * F.col("z"))
    e, cube = mesh.structured_elements(spark, [n] * 3), Cube((0.0, 0.0, 0.0), 4.0)
    made = interpolate.cube_map(e, nodes, cube, 3)
    interpolate.write_field_map(made, str(tmp_path / "map"))
    kept = interpolate.read_field_map(spark, str(tmp_path / "map"))
    simplex = interpolate.simplex_map(e, nodes, cube, 3)
    for m in (kept, simplex):
        rows = interpolate.apply_map(m, nodes, "v", 3).collect()
        assert len(rows) == 9**3 and all(abs(r.value - (r.nx + 2 * r.ny + 3 * r.nz) / 2) < 1e-9 for r in rows)
    refined = interpolate.refined_points(e, nodes, "v", 3, 1.0).collect()
    assert all(abs(r.v - (r.x + 2 * r.y + 3 * r.z)) < 1e-9 for r in refined)


def test_dense_fill():
    for dim in (1, 2, 3):
        v = np.full((9,) * dim, np.nan)
        corner = np.indices((2,) * dim).reshape(dim, -1).T * 8
        for c in corner:
            v[tuple(c)] = sum((d + 1) * x for d, x in enumerate(c))
        want = sum((d + 1) * g for d, g in enumerate(np.indices(v.shape)))
        assert np.allclose(dense.fill_cube(v.copy()), want)  # linear fields are exact
        v[tuple(corner[0])] = np.nan
        out = dense.fill_cube(v)
        assert np.isnan(out[tuple(corner[0])]) and np.isnan(out[(0,) * (dim - 1) + (4,)])  # missing spreads


def test_view_helpers(spark):
    m = np.eye(4)
    assert view.view_rectangle([(-0.5, -0.5, 0), (0.5, 0.5, 0)], m, 100, 50) == (25, 12, 75, 38)
    behind = m.copy()
    behind[3] = [0, 0, 0, -1]
    assert view.view_rectangle([(0, 0, 0)], behind, 100, 50) == (0, 0, 100, 50)
    cam = view.Camera().reset()
    far = np.linalg.norm(cam.eye)
    assert np.isclose(far, 10.1 * np.sqrt(3) / (2 * np.sin(np.pi / 12))) and np.allclose(cam.eye / far, np.array([2, 1, 3]) / np.sqrt(14))
    turned = cam.rotated(200, 0).rotated(0, 30)  # 200 pixels are a quarter turn, here about the picture's upward axis
    assert np.isclose(np.linalg.norm(turned.eye), far) and np.allclose(turned.matrix[:3, :3] @ turned.matrix[:3, :3].T, np.eye(3))
    assert abs(cam.rotated(200, 0).eye @ cam.eye) < 1e-6 + far**2 * 0.2
    assert np.isclose(np.linalg.norm(turned.zoomed(1.0).eye), far / np.e) and np.allclose(turned.zoomed(1.0).zoomed(-1.0).matrix, turned.matrix)
    moved = cam.panned(200, 0)  # the picture's half height at the centre's distance
    assert np.isclose(np.linalg.norm(moved.centre), far * np.tan(np.pi / 12)) and np.allclose(moved.eye - moved.centre, cam.eye)
    tilted = view.Camera(turned.matrix).upright()
    assert np.allclose(tilted.eye, turned.eye) and abs(tilted.matrix[0, 1]) < 1e-9 and tilted.matrix[1, 1] > 0
    mouse = view.Mouse(cam)
    for s in [(0, 10, 10, 1), (40, 30, 10, 1), (80, 30, 10, 0)]:  # dragged with the left button
        mouse.state(*s)
    assert np.allclose(mouse.camera.matrix, cam.rotated(20, 0).matrix)
    mouse.state(90, 30, 10, 0, 120)
    assert np.isclose(np.linalg.norm(mouse.camera.eye), far / np.e)
    mouse.state(100, 30, 10, 8, 120)
    assert np.isclose(np.linalg.norm(mouse.camera.eye), far / np.exp(1.1))
    for s in [(4900, 0, 0, 0), (5000, 0, 0, 1), (5050, 0, 0, 0), (5100, 0, 0, 1), (5150, 0, 0, 0)]:  # a double click
        mouse.state(*s)
    assert np.allclose(mouse.camera.matrix, cam.matrix)
    s = view.samples(spark.createDataFrame([(0, 1.0, 3.0)], "pixel int, enter double, leave double"), view.sample_count(F.lit(2.0), 1.0, 2.0)).orderBy("step").collect()
    assert [r.t for r in s] == [1, 1.5, 2, 2.5, 3]
    table = colors.transfer_table([(0, 0, 0, 0, 0), (1, 1, 0.5, 0, 1)], 5)
    assert table[2] == (0.5, 0.25, 0, 0.5)
    got = spark.range(1).select(colors.table_lookup(F.array(*(F.lit(x[0]) for x in table)), F.lit(0.6), 0.0, 1.0, 5).alias("v"), view.trilinear([F.lit(0.5)] * 3, [F.lit(float(i)) for i in range(8)]).alias("t"), colors.absolute_level(F.lit(2.0), F.lit(4.0), 0.25).alias("l"), colors.pack_floor(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("p")).first()
    assert abs(got.v - 0.6) < 1e-12 and got.t == 3.5 and got.l == 2.5 and got.p == 0xFFFF0000
    over = spark.createDataFrame([((255, 10, 20, 30), (128, 200, 100, 0))], "d struct<a:long,r:long,g:long,b:long>, s struct<a:long,r:long,g:long,b:long>").select(colors.over_bytes(F.col("d"), F.col("s")).alias("o")).first().o
    assert over.a == 255 and over.r == (200 * 128 + 10 * 127) // 255


def test_geometry(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    one = spark.range(1).select(
        F.array(*vectors.face_normal([lit(0, 0, 0), lit(1, 0, 0), lit(1, 1, 0), lit(0, 1, 0)])).alias("quad"),
        F.array(*vectors.face_normal([lit(0, 0), lit(0, 0)])).alias("none"),
        F.array(*vectors.solve3([lit(2, 0, 0), lit(0, 4, 0), lit(0, 0, 5)], lit(2, 8, 15))).alias("solved"),
        F.array(*vectors.solve3([lit(1, 2, 3), lit(2, 4, 6), lit(0, 0, 1)], lit(1, 1, 1))).alias("singular"),
        vectors.signed_shift_right(F.lit(8), F.lit(2)).alias("r"),
        vectors.signed_shift_right(F.lit(8), F.lit(-2)).alias("l"),
        vectors.orientation(lit(1, -3, 2)).alias("o"),
        boxes.size_min_positive((lit(0, 0), lit(0, 2))).alias("mp"),
        vectors.clamp(F.lit(9), 0, 5).alias("c"),
        F.array(*[x for row in vectors.invert3([lit(2, 0, 0), lit(0, 4, 0), lit(0, 0, 8)]) for x in row]).alias("inv"),
        cells.pop_count_high(F.lit(0b1011), 4, F.lit(3)).alias("pop"),
    ).first()
    assert one.quad == [0, 0, 1] and one.none == [0, 0] and one.solved == [1, 2, 3] and one.singular == [None] * 3
    assert (one.r, one.l, one.o, one.mp, one.c, one.pop) == (2, 32, -1, 2, 5, 2)
    assert [one.inv[i] for i in (0, 4, 8)] == [0.5, 0.25, 0.125]
    assert cells.sufficient_depth([16, 3]) == 4 and cells.sufficient_depth([17]) == 5 and cells.vertex_count(2, 2) == 25


def test_view_state():
    t = plan.ParameterTree({"camera": {"fov": 45.0, "planes": []}, "mode": "MIP"})
    assert t.names("camera") == ["fov", "planes"]
    t.set("camera.fov", 30)
    assert t.get("camera.fov") == 30
    for path, value, error in (("mode", 3, TypeError), ("camera.x", 1, KeyError)):
        with pytest.raises(error):
            t.set(path, value)
    with pytest.raises(TypeError):
        t.names("mode")
    q = plan.changed(plan.ViewQuery(), level=3)
    assert q.level == 3
    with pytest.raises(TypeError):
        plan.changed(q, level="a")
    w = plan.Workers()
    w.register("Default", dict)
    assert w.create() == {}
    with pytest.raises(KeyError):
        w.create("other")
    edges = plan.render_tasks(3, 2)
    assert len({a for a, _ in edges}) == len(edges) and edges[-1][1] == "compose"


def test_field_service(spark):
    rows = [("p", 0, 1, 0, 0, x, y, float(x + y)) for x in (0, 4) for y in (0, 4)] + [("q", 0, 1, 0, 0, 0, 0, 1.0)]
    sparse = spark.createDataFrame(rows, "field string, frame int, level int, ix int, iy int, nx int, ny int, value double")
    s = plan.FieldService(sparse, [("p", 0.0, 8.0, False), ("q", 1.0, 1.0, False)], 1, 2, 2)
    assert s.names() == ["p", "q"] and s.range("p") == (0.0, 8.0) and s.resolved("zzz") == "p" and s.dense_size() == 25
    got = {(r.nx, r.ny): r.value for r in s.dense(plan.ViewQuery(primary="zzz", level=1, index_box=((0, 0), (2, 2)))).collect()}
    assert got == {(x, y): float(x + y) for x in range(5) for y in range(5)}
    assert s.of_query(plan.ViewQuery(primary="p", level=2)).count() == 0
    assert (s.frame_of(2.9), s.time_of(2), s.time_count()) == (2, 2.0, 1)


def test_parameters():
    c = prepare.ExactConfig.merged('{"time_step": 0.5, "odd": 1}', time_step_count=4)
    assert (c.time_step, c.time_step_count, c.init_time) == (0.5, 4, 0.0)
    p = prepare.Parameters()
    assert (p.depth, p.max_level, p.refine, p.boundary_refine, p.dim, p.boundary, p.threads) == (7, 20, 1.0, 1, 3, True, 1)
    prepare.register("half", lambda x, y, z, t: x / 2)
    assert "half" in prepare.FUNCTIONS


def test_command_line_modes(spark, tmp_path):
    from octavo.sources import formats

    y, x = np.mgrid[0:9, 0:9]
    path = str(tmp_path / "m.bin")
    formats.write_binary_mesh(path, ["x", "y", "F"], [([9, 9], np.stack([x.ravel(), y.ravel(), (x + y).ravel()], 1))])
    info = prepare.run(spark, prepare.Parameters(mode="mesh_info", mesh_file=path)).collect()
    assert {(r.zone, r.elements, r.nodes) for r in info} == {("0", 64, 81), (None, 64, 81)}
    out = str(tmp_path / "out")
    assert prepare.run(spark, prepare.Parameters(mode="mesh", mesh_file=path, output=out, depth=3)).count() > 0
    assert prepare.run(spark, prepare.Parameters(mode="meta_info", output=out, dim=2)).count() > 0
    from octavo.sources import readers, writers

    field = writers.read_field(spark, f"{out}/fields", "F", 0)
    # the field is x + y, and so it is at every node inside of the mesh
    top = field.where("level = 0").collect()
    assert top and all(0 <= r.value <= 16 for r in top)
    assert {r.field for r in spark.read.parquet(f"{out}/fields").select("field").distinct().collect()} == {"shape", "F"}
    steps, rows = readers.read_field_info("\n".join(r.value for r in spark.read.text(f"{out}/fields_info").collect()) + "\n")
    assert steps == 1 and rows[0][:3] == ("shape", -1.0, 1.0) and rows[1][0] == "F" and 0 <= rows[1][1] < rows[1][2] <= 16
    # several frames and fields, in jobs of two frames; the map is that of frame 0
    (tmp_path / "run").mkdir()
    grid = np.stack([x.ravel(), y.ravel(), (x + y).ravel(), (x - y).ravel()], 1)
    for i in range(3):
        formats.write_binary_mesh(str(tmp_path / "run" / f"run_t{i:06d}.bin"), ["x", "y", "F", "G"], [([9, 9], grid * [1, 1, i + 1, 1])])
    out = str(tmp_path / "out_frames")
    prepare.run(spark, prepare.Parameters(mode="mesh", mesh_file=str(tmp_path / "run.bin"), output=out, depth=2, max_level=3, refine=0.5, boundary=False, threads=2))
    frames = {(r.field, r.frame): (r.n, r.s) for r in spark.read.parquet(f"{out}/fields").groupBy("field", "frame").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert set(frames) == {(f, i) for f in "FG" for i in range(3)} and len({n for n, _ in frames.values()}) == 1
    assert abs(frames["F", 2][1] - 3 * frames["F", 0][1]) < 1e-6 and abs(frames["G", 2][1] - frames["G", 0][1]) < 1e-6
    assert spark.read.text(f"{out}/fields_info").first()[0] == "time_steps\t3"
    # a voxel image and an analytic problem
    axis = np.arange(9.0)
    formats.write_rect_grid(str(tmp_path / "i.grid"), formats.RectGrid([9, 9], [axis, axis], {"p": np.arange(64.0)}))
    out = str(tmp_path / "out_image")
    assert prepare.run(spark, prepare.Parameters(mode="image", mesh_file=str(tmp_path / "i.grid"), output=out, dim=2, depth=2, centre="4,4", radius=3)).count() > 0
    assert {r.field for r in spark.read.parquet(f"{out}/fields").select("field").distinct().collect()} == {"shape", "p", "coord_x", "coord_y"}
    (tmp_path / "e.json").write_text('{"cell_count": {"x": 4, "y": 4, "z": 4}, "time_step_count": 2, "domain": {"min": {"x": -1, "y": -1, "z": 0.1}, "max": {"x": 1, "y": 1, "z": 2.1}}}')
    out = str(tmp_path / "out_exact")
    assert prepare.run(spark, prepare.Parameters(mode="exact", config=str(tmp_path / "e.json"), output=out, dim=3, depth=2)).count() == 1
    assert spark.read.parquet(f"{out}/fields").groupBy("frame").count().orderBy("frame").collect() == [(0, 125), (1, 125)]
    with pytest.raises(ValueError):
        prepare.run(spark, prepare.Parameters(mode="merge"))


def test_telemetry_errors(spark):
    rows = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.5)], "k int, o int, t double")
    with pytest.raises(Exception, match="not monotone"):
        telemetry.checked_monotone(rows, ["k"], ["o"], "t").collect()
    assert telemetry.frame_range("2-$", 9) == (2, 8) and telemetry.frame_range("none", 3) is None
    for bad in ("3-1", "0-9", "x"):
        with pytest.raises(ValueError):
            telemetry.frame_range(bad, 5)
    assert telemetry.matching_columns(["a", "ab", "b"], "a.?") == ["a", "ab"] and telemetry.matching_columns(["a"], "") == ["a"]
    assert telemetry.legend()[0] == ("ClearViewport", 0)


def test_fixed_formulas(spark):
    """Values worked out by hand from the formulas."""
    from octavo.functions import colors
    from octavo.sources import readers

    one = spark.range(1)
    assert abs(one.select(readers.waves(F.lit(0.3), F.lit(0.2), F.lit(0.5), 0.0)).first()[0] + 0.8110) < 1e-4
    assert readers.sphere_counts(3, 8) == [2, 2, 2] and readers.sphere_counts(2, 4) == [2, 2] and readers.sphere_counts(1, 7) == [7]
    line = readers.sphere(spark, 1, 3, r1=1.0, r2=3.0, scale=(2.0, 1.0, 1.0)).orderBy("node_id").collect()
    # steps grow with the radius: a = 2 * 2 / 4 = 1, b = 2 * 1 * 2 / 4 = 1, so r(1/2) = 1 + 0.5 * 1.5
    assert [round(r.xx, 6) for r in line] == [1.0, 1.75, 3.0] and [r.x for r in line] == [2 * r.xx for r in line]
    flat = readers.cube(spark, 1, 5, ratios=(8.0, 1.0, 1.0)).orderBy("node_id").collect()
    assert [round(r.xx * 15, 6) for r in flat] == [0, 1, 3, 7, 15] and abs(flat[0].F - np.sin(2 * np.pi / 5e-10)) < 1e-6
    square = readers.cube(spark, 2, 9, half=2.0).where("node_id = 4").first()
    assert (square.x, square.y, square.lin) == (0, 0, 0) and square.F == 0  # no angle at the middle
    # a light from behind: the normal turns to it, and shines back
    v = lambda *x: [F.lit(float(i)) for i in x]
    turned = colors.facing(v(0, 0, -1), v(0, 0, 1))
    assert one.select(colors.blinn(turned, v(0, 0, 1), v(0, 0, 1), 0.1, 0.5, 0.25, 8.0)).first()[0] == 0.85
    # a light at right angles reaches nothing, so there is no highlight either
    assert abs(one.select(colors.blinn(v(0, 0, 1), v(1, 0, 0), v(0, 0, 1), 0.1, 0.5, 0.25, 8.0)).first()[0] - 0.1) < 1e-12
    light = {"pos": (0, 0, 5), "ambient": (0.1, 0.1, 0.1), "diffuse": (1, 0.5, 0), "specular": (0.2, 0.2, 0.2)}
    shade = one.select(*colors.shaded(v(0, 0, 1), v(0, 0, 9), v(0, 0, 0), v(0.5, 0.5, 0.5), [light, light])).first()
    assert [round(x, 9) for x in shade] == [1.0, 0.9, 0.4]


def test_unpacked_alpha(spark):
    """What was packed comes back, an alpha above 1 too; a signed 32-bit pixel has bytes."""
    p = colors.pack_round(F.lit(1.0), F.lit(0.0), F.lit(0.2), F.col("a"))
    rows = spark.createDataFrame([(0.0,), (1.0,), (560.21 / 500,)], "a double").select("a", *(c.alias(n) for n, c in zip("rgbo", colors.unpack(p), strict=True)))
    assert sorted(tuple(r)[1:] for r in rows.collect()) == [(255, 0, 51, 0), (255, 0, 51, 255), (255, 0, 51, 286)]
    signed = spark.createDataFrame([(-16777216 + 515,)], "p int").select(*colors.unpack(F.col("p"))).first()
    assert tuple(signed) == (0, 2, 3, 255)


def test_rounded_as_sql(spark):
    """Ties of decimal digits that are none in binary, and the other way round."""
    values = [520.2475, 1047.0075, 523.6225, -1039.1325, 1.0005, 2.5, 0.0, 1e-9]
    want = [x for (x,) in duckdb.sql(f"SELECT round(x, 3) FROM (SELECT unnest({values}::DOUBLE[]) AS x)").fetchall()]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", rounded(F.col("x"), 3).alias("r"))
    assert [r.r for r in sorted(rows.collect())] == want


def test_clicks(spark):
    """Press, release, press, a long hold, release: no click, but a double click; another button makes both presses void."""
    states = [(0, 1), (50, 0), (100, 1), (480, 0), (600, 1), (700, 0), (720, 1), (740, 4), (760, 0), (800, 1), (850, 0)]
    e = spark.createDataFrame([(1, ms, f) for ms, f in states], "k int, ms long, flags int")
    got = {r.ms: (r.click, r.double_click) for r in stateful.clicks(e, ["k"], ["ms"], "ms", "flags").collect()}
    assert got == {50: (True, False), 480: (False, True), 700: (True, False), 850: (True, False)}


def test_folds_do_not_depend_on_batches(spark):
    """Quality in pieces, and as a stream whose groups arrive in many frames."""
    rng = np.random.default_rng(3)
    rows = [(int(k), i, float(v)) for k, (i, v) in zip(rng.integers(0, 2, 400), enumerate(rng.random(400)), strict=True)]
    df = spark.createDataFrame(rows, "k int, order long, v double")

    def plain(values):
        ring, q = [0.0] * 20, 50
        for n, v in enumerate(values):
            ring[n % 20] = v
            a = sum(ring) / 20
            q = max(10, min(100, q - (a > 0.5) + (a < 0.4)))
        return q

    want = {k: plain([v for kk, _, v in rows if kk == k]) for k in (0, 1)}
    old, stateful.PIECE = stateful.PIECE, 7
    try:
        assert {r.k: r.quality for r in stateful.adaptive_quality(df, ["k"], ["order"], "v").collect()} == want
    finally:
        stateful.PIECE = old
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        path = tempfile.mkdtemp()
        df.orderBy(F.desc("order")).write.mode("overwrite").parquet(f"{path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{path}/in")
        q = stateful.adaptive_quality_stream(stream, "k", "v").writeStream.outputMode("update").format("memory").queryName("folds_test").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {r.k: r.quality for r in spark.table("folds_test").collect()} == want
        t = spark.createDataFrame([(1, 10 * i) for i in range(200)], "k int, ms long")
        assert sorted(r.ms for r in stateful.throttled(t, ["k"], "ms").collect()) == list(range(0, 2000, 40))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        shutil.rmtree(path, ignore_errors=True)


def test_stream_adds_from_the_oldest(spark):
    """Averages at a limit hang on the order of addition, samples of one time on the next column; a null counts nothing."""
    v = [None, *np.round(np.random.default_rng(62).random(27), 2).tolist()]
    want, values = 50, [x or 0.0 for x in v]
    for n in range(1, len(v)):
        total = 0.0
        for x in values[max(0, n - 19) : n + 1]:
            total += x
        want += -1 if total / 20 > 0.5 else 1 if total / 20 < 0.4 else 0
    df = spark.createDataFrame([(1, i // 5, i, x) for i, x in enumerate(v)], "k int, order long, n long, v double")
    path = tempfile.mkdtemp()
    try:
        df.coalesce(1).orderBy(F.desc("n")).write.mode("overwrite").parquet(f"{path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{path}/in")
        made = stateful.adaptive_quality_stream(stream, "k", "v", order=("order", "n"))
        made.writeStream.outputMode("update").format("memory").queryName("oldest_test").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        assert [r.quality for r in spark.table("oldest_test").collect()] == [want] == [r.quality for r in stateful.adaptive_quality(df, ["k"], ["order", "n"], "v").collect()]
    finally:
        shutil.rmtree(path, ignore_errors=True)


def test_hot_root(spark, points):
    """Every point lies below the root; what meets it are the sums of its blocks, not the points."""
    many = points.drop("id").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50))))
    made = prepare.points_problem(many, 3, "one", 3, 2)
    assert made.sparse.where("abs(value - 7) > 1e-9").count() == 0


def test_throttle_and_pressure(spark):
    e = spark.createDataFrame([(1, t) for t in (0, 10, 39, 40, 41, 80, 200)], "k int, ms long")
    assert sorted(r.ms for r in stateful.throttled(e, ["k"], "ms").collect()) == [0, 40, 80, 200]
    # two frames before any is confirmed; the acknowledgement of frame 1 confirms frame 0 as well
    kinds = [("send", None)] * 4 + [("ack", 1)] + [("send", None)] * 3 + [("ack", 0), ("send", None), ("ack", 3), ("send", None)]
    p = spark.createDataFrame([(1, i, k, n) for i, (k, n) in enumerate(kinds)] + [(2, 0, "ack", 5)], "k int, o int, kind string, number long")
    assert sorted(map(tuple, stateful.pending(p, ["k"], ["o"], "kind", "number").collect())) == [(1, 5, 4, 3), (2, 0, 0, 5)]
    r = stateful.Restartable(spark, "frames")
    assert r.restart(lambda: 1) == 1 and r.restart(lambda: 2) == 2 and r.number == 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sessions_as_a_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, 0), (1, 5), (1, 100), (2, 3)], "k int, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    e.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in stateful.sessions(e, "k", "ts", 10).collect()}
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    q = stateful.sessions(stream, "k", "ts", 10).writeStream.outputMode("complete").format("memory").queryName("sessions_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("sessions_test").collect()} == batch and len(batch) == 3
