"""File formats: round trips and errors."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from octavo.operators import mesh
from octavo.sources import formats, readers, writers


@pytest.fixture
def grid():
    y, x = np.mgrid[0:4, 0:5]
    return np.stack([x.ravel(), y.ravel(), (x * 2 + y).ravel()], 1).astype(float)


def test_binary_mesh(spark, tmp_path, grid):
    path = str(tmp_path / "a.bin")
    formats.write_binary_mesh(path, ["X", "Y", "F"], [([5, 4], grid), ([5, 4], grid + 1)])
    nodes = readers.read_mesh(spark, path, rows=7)
    assert nodes.rdd.getNumPartitions() == 6 and nodes.count() == 40
    rows = {(r.zone_id, r.node_id): (r.X, r.Y, r.F) for r in nodes.collect()}
    assert rows[1, 19] == tuple(grid[19] + 1)
    only = readers.read_mesh(spark, path, variables=["F"])
    assert only.columns == ["zone_id", "node_id", "F"]
    elements = readers.read_mesh(spark, path, "elements").where("zone_id = 0")
    same = mesh.structured_elements(spark, [5, 4])
    assert sorted(map(tuple, elements.select("element_id", "nodes").collect())) == sorted(map(tuple, same.select("element_id", "nodes").collect()))
    zones = readers.read_mesh(spark, path, "zones").collect()
    assert [(z.nodes, z.elements, z.etype) for z in zones] == [(20, 12, "quad")] * 2
    assert {r.zone_id: r.nodes for r in readers.zone_counts(nodes).collect()} == {0: 20, 1: 20}
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", 3) + b"abc")
    with pytest.raises(formats.FormatError):
        formats.layout(path)


def test_text_mesh(spark, tmp_path, grid):
    path = tmp_path / "a.tec"
    path.write_text('TITLE = "t"\nVARIABLES = "X", "Y", F\n# note\nTEXT X=1\nzone T="one" i=5, j=4, F=POINT\n' + "\n".join(" ".join(map(str, r)) for r in grid) + '\nZONE T="two", N=4, E=2, ET=TRIANGLE, F=FEPOINT, Q=9\n0 0 1\n1 0 2\n1 1 3\n0 1 4\n\n1 2 3\n1 3 4\n')
    nodes = readers.read_mesh(spark, str(path), rows=6)
    assert nodes.count() == 24
    assert [tuple(r) for r in nodes.where("zone_id = 1").orderBy("node_id").select("X", "F").collect()] == [(0, 1), (1, 2), (1, 3), (0, 4)]
    elements = readers.read_mesh(spark, str(path), "elements").where("zone_id = 1").orderBy("element_id").collect()
    assert [list(r.nodes) for r in elements] == [[0, 1, 2], [0, 2, 3]] and elements[0].etype == "triangle"
    lines = "\n".join(writers.text_mesh(["X", "Y", "F"], [([5, 4], grid)]))
    (tmp_path / "b.tec").write_text(lines)
    again = readers.read_mesh(spark, str(tmp_path / "b.tec"))
    assert again.agg(F.sum("F")).first()[0] == grid[:, 2].sum()


@pytest.mark.parametrize("text", ["A = 1", 'FILETYPE = "ODD"', "VARIABLES = X\nZONE I=2, N=3\n1\n2", "VARIABLES = X\nZONE I=3\n1\n2", "VARIABLES = X\nZONE N=1, E=1, ET=BLOB\n1", "VARIABLES = X\nZONE I=a\n1"])
def test_text_mesh_errors(tmp_path, text):
    path = tmp_path / "a.tec"
    path.write_text(text)
    with pytest.raises(formats.FormatError):
        formats.layout(str(path))


def test_roles():
    assert formats.roles(["X", "y", "T", "u"]) == (["X", "y"], ["T", "u"])
    for bad in (["y"], ["z"], ["x", "z"], ["y", "z"], ["x", "X"]):
        with pytest.raises(formats.FormatError):
            formats.roles(bad)
    with pytest.raises(formats.FormatError):
        formats.layout("a.unknown")


def test_animation(spark, tmp_path):
    shapes, rng = [(2, 2, 2), (3, 2, 2)], np.random.default_rng(0)
    xyz = [rng.random((int(np.prod(s)), 3)).astype("<f4") for s in shapes]
    (tmp_path / "grid").write_bytes(struct.pack("<I", 2) + b"".join(struct.pack("<3i", *s) + x.tobytes() for s, x in zip(shapes, xyz, strict=True)))
    steps = [[rng.random((len(x), 4)).astype("<f4") for x in xyz] for _ in range(3)]
    (tmp_path / "field").write_bytes(b"".join(struct.pack("<2i", i, i) + b"".join(f.tobytes() for f in s) for i, s in enumerate(steps)))
    (tmp_path / "a.anim").write_text("grid\nfield\n2\n")
    rows = readers.read_mesh(spark, str(tmp_path / "a.anim"), rows=5).where("zone_id = 1").orderBy("node_id").collect()
    assert len(rows) == 12
    assert np.allclose([[r.x, r.y, r.z, r.DP_DT, r.U, r.GRAD_RO, r.Qcr] for r in rows], np.hstack([xyz[1], steps[2][1]]))


def test_manifest(spark, tmp_path):
    xyz = np.arange(27, dtype="<f8").reshape(9, 3)
    values = np.arange(18, dtype="<f4").reshape(9, 2)
    elements = np.array([[0, 1, 2, 3, 4, 5, 6, 7], [0, 1, 2, 3, 4] + [0xFFFFFFFF] * 3], "<u4")
    (tmp_path / "info").write_text("Name block NumCoords 3 NnBase 9 NtBase 2")
    (tmp_path / "xyz").write_bytes(b"\0" * 12 + xyz.tobytes())
    (tmp_path / "elements").write_bytes(b"\0" * 12 + elements.tobytes())
    (tmp_path / "finfo").write_text('Fields 2 Variables "p" q')
    (tmp_path / "fields").write_bytes(values.tobytes())
    (tmp_path / "a.imm-g").write_text("info\nxyz\nelements\nfinfo\nfields\n")
    path = str(tmp_path / "a.imm-g")
    nodes = readers.read_mesh(spark, path, rows=4).orderBy("node_id").collect()
    assert [nodes[8].x, nodes[8].p, nodes[8].q] == [24, 16, 17]
    rows = [list(r.nodes) for r in readers.read_mesh(spark, path, "elements").orderBy("element_id").collect()]
    assert rows == [[0, 1, 3, 2, 4, 5, 7, 6], [0, 1, 2, 3, 4, None, None, None]]
    kinds = mesh.with_subtype(readers.read_mesh(spark, path, "elements")).orderBy("element_id").collect()
    assert [k.subtype for k in kinds] == ["hexahedron", "pyramid"]


def test_rect_grid(spark, tmp_path):
    path = str(tmp_path / "g")
    g = formats.RectGrid([4, 3], [np.arange(4.0), np.arange(3.0)], {"Color": np.arange(6, dtype=np.int32) - 1, "T": np.arange(6.0)})
    formats.write_rect_grid(path, g)
    rows = readers.read_voxels(spark, path, 2, slab=4).orderBy("iy", "ix").collect()
    assert [(r.ix, r.iy, r.Color, r.T) for r in rows] == [(i % 3, i // 3, i - 1, float(i)) for i in range(6)]
    assert readers.read_voxels(spark, path, 2, ["T"]).columns == ["ix", "iy", "T"]
    with pytest.raises(formats.FormatError):
        formats.read_rect_grid(path, 3)


def test_vtk(tmp_path):
    path = tmp_path / "v.vtk"
    path.write_text("# vtk DataFile Version 3.0\nx\nASCII\nDATASET RECTILINEAR_GRID\nDIMENSIONS 3 2 1\nX_COORDINATES 3 float\n0 1 2\nY_COORDINATES 2 float\n5 6\nZ_COORDINATES 1 float\n0\nCELL_DATA 2\nSCALARS c int 1\nLOOKUP_TABLE default\n7 8\nFIELD f 1\nt 1 2 double\n0.5 1.5\n")
    g = formats.read_vtk_rectilinear(str(path))
    assert g.shape == [3, 2] and g.coordinates[1].tolist() == [5, 6] and g.arrays["c"].tolist() == [7, 8] and g.arrays["t"].tolist() == [0.5, 1.5]


def test_telemetry(spark, tmp_path):
    block = "b\t{0}\t2\t3\tp\t.1\t.2\t.3\ts\t.4\t.5\t.6\t.7\t.8"
    row = lambda n, k: "\t".join([str(n), "0", "1", "1.5", "1.6", "1.7", str(k), *(block.format(i) for i in range(k)), "f", "2.1", "2.2", "2.3"])
    path = tmp_path / "log"
    path.write_text(f"{row(0, 2)}\n\n{row(1, 0)}\n-\n{row(2, 1)}\n-\n")
    rows = readers.read_telemetry(spark, str(path)).orderBy("line").collect()
    assert [(r.frame, r.node, len(r.blocks)) for r in rows] == [(0, 0, 2), (0, 1, 0), (1, 2, 1)]
    assert rows[0].blocks[1].ix == 1 and rows[0].blocks[1].times == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
    assert (rows[1].after_copy, rows[2].after_store) == (2.1, 2.3)
    out = [r.value for r in writers.telemetry_lines(readers.read_telemetry(spark, str(path)).select("frame", "line", "node", "start")).collect()]
    assert out == ["0\t1.5", "1\t1.5", "-", "2\t1.5", "-"]


def test_catalogues(spark, tmp_path):
    text = writers.field_info(3, [("p", 0.5, 2.0, True), ("q", 0.0, -1.0, False)], boundary=True)
    assert readers.read_field_info(text) == (3, [("shape", -1.0, 1.0, False), ("p", 0.5, 2.0, True), ("q", None, None, False)])
    with pytest.raises(formats.FormatError, match="line 1"):
        readers.read_field_info("x")
    with pytest.raises(formats.FormatError, match="line 5"):
        readers.read_field_info("time_steps\t1\n1\n\nheader\nname only")
    (tmp_path / "p.json").write_text('{"problems": [{"name": "a", "path": "/x"}, {"name": "b", "path": "/y"}]}')
    assert [tuple(r) for r in readers.read_problems(spark, str(tmp_path / "p.json")).collect()] == [("a", "/x"), ("b", "/y")]
    assert readers.frame_file("/d/run.bin", 7) == "/d/run/run_t000007.bin"
    assert readers.first_frame("a.bin", lambda p: True, lambda p: False) == ("a.bin", False)
    assert readers.first_frame("/d/run.bin", lambda p: False, lambda p: True) == ("/d/run/run_t000000.bin", True)
    with pytest.raises(FileNotFoundError):
        readers.first_frame("a.bin", lambda p: False, lambda p: False)
    assert readers.times(1, 3, 3) == [1, 2, 3]
    assert writers.read_bounds(writers.bounds_text([0.1, 0], [1, 2])) == ([0.1, 0], [1, 2])
    log = writers.request_log(spark.createDataFrame([(5, "u", "/vs; x")], "time long, user string, request string"))
    assert tuple(writers.parse_request_log(log).first()) == (5, "u", "/vs; x")
    assert writers.key_values({"a": 1}) == "a=1\n"


def test_tables(spark, tmp_path):
    subtrees = spark.createDataFrame([(0, 0, 0, 2), (1, 1, 0, 2)], "level int, ix int, iy int, depth int")
    path = str(tmp_path / "meta")
    writers.write_metadata(subtrees, path, 0, 2, 2)
    back, info = writers.read_metadata(spark, path, 2)
    assert back.count() == 2 and info["format_version"] == 1
    with pytest.raises(formats.FormatError):
        writers.read_metadata(spark, path, 3)
    subtrees.write.partitionBy("level").parquet(str(tmp_path / "old/subtrees"))
    assert writers.read_metadata(spark, str(tmp_path / "old"), 2)[1] == {"format_version": 0, "max_full_level": 0, "depth": 2, "dim": 2}
    values = subtrees.withColumn("value", F.lit(1.5))
    assert writers.write_field(values, str(tmp_path / "f"), "p", 0, 2) and not writers.write_field(values, str(tmp_path / "f"), "p", 0, 2)
    assert writers.read_field(spark, str(tmp_path / "f"), "p", 0).count() == 2
    writers.swap_in(values, str(tmp_path / "frame"))
    writers.swap_in(values.limit(1), str(tmp_path / "frame"))
    assert writers.read_swapped(spark, str(tmp_path / "frame")).count() == 1
    (tmp_path / "frame" / "v000000000002").mkdir()  # a write that did not come to its end
    assert writers.read_swapped(spark, str(tmp_path / "frame")).count() == 1
    with pytest.raises(FileNotFoundError):
        writers.read_swapped(spark, str(tmp_path / "none"))
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "from string, to string")
    assert writers.graph_dot(edges) == 'digraph {\n  "a" -> "b";\n  "b" -> "c";\n}\n'
    writers.write_tsv(values, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 2
