"""Registered queries of sources and sinks: what is written from a view of the test tables and read back."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octavo.functions.cells import cube_of
from octavo.operators import fields, interpolate, mesh, telemetry, tree
from octavo.plans.adapters import frames, grid2, img2, pts2, tele, with_views
from octavo.plans.registry import ORACLES, query
from octavo.sources import formats, readers, writers
from octavo.storage import new_path, sized


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files that are written and read by path."""
    at = new_path(spark, name).removeprefix("file://")
    at = at.removeprefix("file:")
    os.makedirs(at, exist_ok=True)
    return at


def _grid(spark: SparkSession, d: str) -> np.ndarray:
    """The 17 x 17 lattice's x, y, v in order of node: 289 rows at any size of the tables."""
    rows = grid2(spark, d).orderBy("node_id").select("x", "y", "v").collect()
    return np.array([tuple(r) for r in rows], float)


def _file(spark: SparkSession, d: str, kind: str) -> str:
    at = folder(spark, "mesh")
    if kind == "text":
        with open(f"{at}/grid.tec", "w") as f:
            f.write("\n".join(writers.text_mesh(["X", "Y", "V"], [([17, 17], _grid(spark, d))])) + "\n")
        return f"{at}/grid.tec"
    formats.write_binary_mesh(f"{at}/grid.bin", ["X", "Y", "V"], [([17, 17], _grid(spark, d))])
    return f"{at}/grid.bin"


NODES = with_views("grid2", body="SELECT zone_id, node_id, x AS \"X\", y AS \"Y\", v AS \"V\" FROM grid2")


@query(NODES)
def text_mesh_grid2(spark, d):
    """A text mesh, written and scanned in parts of 50 rows."""
    return readers.read_mesh(spark, _file(spark, d, "text"), rows=50)


@query(NODES)
def binary_mesh_grid2(spark, d):
    return readers.read_mesh(spark, _file(spark, d, "binary"), rows=50)


@query(with_views("grid2", body="SELECT zone_id, node_id, v AS \"V\" FROM grid2"))
def projected_mesh_grid2(spark, d):
    """Only the variable asked for is read."""
    return readers.read_mesh(spark, _file(spark, d, "binary"), variables=["V"])


@query(with_views("elem2", body="SELECT zone_id, element_id, 'quad' AS etype, n0, n1, n2, n3 FROM elem2"))
def mesh_elements_file_grid2(spark, d):
    e = readers.read_mesh(spark, _file(spark, d, "text"), "elements", rows=100)
    return e.select("zone_id", "element_id", "etype", *(F.get("nodes", F.lit(i)).alias(f"n{i}") for i in range(4)))


@query("SELECT 0 AS zone_id, 'quad' AS etype, CAST(289 AS BIGINT) AS nodes, CAST(256 AS BIGINT) AS elements")
def mesh_zones_file_grid2(spark, d):
    return readers.read_mesh(spark, _file(spark, d, "binary"), "zones").select("zone_id", "etype", "nodes", "elements")


@query(NODES)
def converted_mesh_grid2(spark, d):
    """A mesh file as Parquet, by zone."""
    at = folder(spark, "converted")
    writers.convert_mesh(spark, _file(spark, d, "text"), f"file://{at}")
    return spark.read.parquet(f"file://{at}/nodes").select("zone_id", "node_id", "X", "Y", "V")


@query(with_views("grid2", body="SELECT 0 AS zone_id, concat(CAST(CAST(x AS INT) AS VARCHAR), chr(9), CAST(CAST(y AS INT) AS VARCHAR)) AS value FROM grid2"))
def mesh_text_grid2(spark, d):
    """Node rows as text, a directory for each zone."""
    at = f"file://{folder(spark, 'text')}"
    writers.mesh_text(grid2(spark, d), ["x", "y"], at)
    parts = F.split("value", "\t")
    return spark.read.text(at).select("zone_id", F.concat_ws("\t", *(F.get(parts, F.lit(i)).cast("double").cast("int").cast("string") for i in range(2))).alias("value"))


@query(with_views("elem2", body="SELECT 'quad' AS subtype, count(*) AS n FROM elem2"))
def elements_by_subtype_grid2(spark, d):
    at = f"file://{folder(spark, 'sections')}"
    writers.by_subtype(mesh.structured_elements(spark, [17, 17]), at)
    return spark.read.parquet(at).groupBy("subtype").agg(F.count("*").alias("n"))


@query(with_views("img2", body="SELECT ix, iy, v, CAST(n AS BIGINT) AS n FROM img2"))
def rect_grid_img2(spark, d):
    """A voxel grid, written and scanned in slabs of 60 cells."""
    rows = img2(spark, d).orderBy("iy", "ix").collect()  # 16 x 16 voxels at any size
    at = f"{folder(spark, 'grid')}/image.grid"
    axis = np.arange(17.0)
    formats.write_rect_grid(at, formats.RectGrid([17, 17], [axis, axis], {"v": np.array([r.v for r in rows]), "n": np.array([r.n for r in rows], np.int64)}))
    return readers.read_voxels(spark, at, 2, slab=60)


@query(with_views("img2", body="SELECT ix, iy, n FROM img2"))
def vtk_grid_img2(spark, d):
    """A legacy ASCII rectilinear grid, turned into the binary one."""
    rows = img2(spark, d).orderBy("iy", "ix").collect()
    at = folder(spark, "vtk")
    ends = " ".join(map(str, range(17)))
    with open(f"{at}/image.vtk", "w") as f:
        f.write(f"# vtk DataFile Version 3.0\nimage\nASCII\nDATASET RECTILINEAR_GRID\nDIMENSIONS 17 17 1\nX_COORDINATES 17 float\n{ends}\nY_COORDINATES 17 float\n{ends}\nZ_COORDINATES 1 float\n0\nCELL_DATA 256\nSCALARS n long 1\nLOOKUP_TABLE default\n" + " ".join(str(r.n) for r in rows) + "\n")
    formats.write_rect_grid(f"{at}/image.grid", formats.read_vtk_rectilinear(f"{at}/image.vtk"))
    return readers.read_voxels(spark, f"{at}/image.grid", 2)


def _subtrees(spark: SparkSession, d: str) -> DataFrame:
    p = pts2(spark, d)
    return tree.storage_subtrees(tree.with_ancestors(tree.occupied(p, cube_of(p, 2), 4), 2), 2, 0, 2)


@query(ORACLES["storage_subtrees_pts2"])
def metadata_file_pts2(spark, d):
    at = f"file://{folder(spark, 'metadata')}"
    writers.write_metadata(_subtrees(spark, d), at, 0, 2, 2)
    subtrees, info = writers.read_metadata(spark, at, 2)
    assert info["depth"] == 2
    return subtrees.select("level", "ix", "iy", "depth")


@query(with_views("grid2", body="SELECT 1 AS level, ix, iy, v AS value FROM grid2 WHERE ix < 8"))
def field_file_grid2(spark, d):
    """One field of one frame of several, pruned by directory; writing it again changes nothing."""
    at = f"file://{folder(spark, 'fields')}"
    g = grid2(spark, d).select((F.col("ix") < 8).cast("int").alias("level"), "ix", "iy", F.col("v").alias("value"))
    for name, frame, rows in (("p", 0, g), ("p", 1, g.withColumn("value", -F.col("value"))), ("q", 0, g.limit(0)), ("p", 0, g.limit(1))):
        writers.write_field(rows, at, name, frame, 2)
    return writers.read_field(spark, at, "p", 0).where("level = 1").select("level", "ix", "iy", "value")


@query(ORACLES["simplex_map_grid2"])
def field_map_file_grid2(spark, d):
    """A field map, stored and applied."""
    g = grid2(spark, d)
    at = f"file://{folder(spark, 'map')}"
    interpolate.write_field_map(interpolate.simplex_map(mesh.structured_elements(spark, [17, 17]), g, cube_of(g, 2), 4), at)
    return interpolate.apply_map(interpolate.read_field_map(spark, at), g, "v", 2).select("nx", "ny", F.round("value", 4).alias("value"))


@query(with_views("frames", body="SELECT field AS name, round(min(value), 2) AS lo, round(max(value), 2) AS hi, true AS animated FROM frames GROUP BY field"))
def field_catalogue_frames(spark, d):
    """The field catalogue's text, written and read back."""
    found = fields.field_range(frames(spark, d), ["field"]).orderBy("field").collect()  # one row for each field
    text = writers.field_info(7, [(r.field, float(r.min), float(r.max), True) for r in found])
    steps, rows = readers.read_field_info(text)
    assert steps == 7
    return spark.createDataFrame(rows, "name string, lo double, hi double, animated boolean").select("name", F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"), "animated")


@query(with_views("pts2", body="SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM pts2"))
def bounds_file_pts2(spark, d):
    row = mesh_bounds(spark, d)
    mins, maxs = writers.read_bounds(writers.bounds_text([row.min_x, row.min_y], [row.max_x, row.max_y]))
    return spark.createDataFrame([(mins[0], maxs[0], mins[1], maxs[1])], "min_x double, max_x double, min_y double, max_y double")


def mesh_bounds(spark: SparkSession, d: str):
    from octavo.functions.cells import bounds

    return bounds(pts2(spark, d), 2).first()


LOG = """+r AS (SELECT n, thread, level, dense_rank() OVER (ORDER BY frame) - 1 AS f, v FROM tele)"""


@query(with_views("tele", body=LOG + " SELECT CAST(f AS INT) AS frame, CAST(thread AS INT) AS thread, CAST(level AS INT) AS level, round(v, 2) AS start, round(v + 1, 2) AS after_clear FROM r"))
def telemetry_log_tele(spark, d):
    """Timing rows as a log's lines, one line after each frame, scanned back with the frames' numbers."""
    t = tele(spark, d)
    days = t.select("frame").distinct()
    days = days.withColumn("f", F.row_number().over(Window.orderBy("frame")) - 1)  # one row for each day
    rows = t.join(sized(days), "frame")
    two = lambda c: F.format_string("%.2f", c)
    line = rows.select(F.col("f").alias("frame"), F.col("n").alias("line"), F.lit("0").alias("node"), F.col("thread").cast("string"), F.col("level").cast("string"), two(F.col("v")).alias("a"), two(F.col("v") + 1).alias("b"), F.lit("0").alias("c"), F.lit("0").alias("n_blocks"), F.lit("f").alias("end"), F.lit("1").alias("x"), F.lit("2").alias("y"), F.lit("3").alias("z"))
    at = f"file://{folder(spark, 'log')}"
    writers.telemetry_lines(line).coalesce(1).write.mode("overwrite").text(at)
    return readers.read_telemetry(spark, at).select("frame", "thread", "level", F.round("start", 2).alias("start"), F.round("after_clear", 2).alias("after_clear"))


@query("SELECT event_id AS time, CAST(user_id AS VARCHAR) AS user, concat('/view; ', event_type) AS request FROM events")
def request_log_events(spark, d):
    """Requests as log lines and back; a request may hold the separator."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return writers.parse_request_log(writers.request_log(e.select(F.col("event_id").alias("time"), F.col("user_id").alias("user"), F.concat(F.lit("/view; "), F.col("event_type")).alias("request"))))


@query(with_views("tele", body="SELECT concat_ws(' ', frame, level, n, thread) AS value FROM tele"))
def client_times_tele(spark, d):
    return writers.client_times(tele(spark, d).select("frame", "level", F.col("n").alias("duration"), F.col("thread").alias("client_frame")))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation")
def tsv_nation(spark, d):
    at = f"file://{folder(spark, 'tsv')}"
    writers.write_tsv(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), at)
    return spark.read.option("sep", "\t").option("header", True).csv(at)


@query("SELECT n_name AS name, concat('/data/', CAST(n_nationkey AS VARCHAR)) AS path FROM nation")
def problem_catalogue_nation(spark, d):
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_name", "n_nationkey").collect()  # 25 nations
    at = f"{folder(spark, 'problems')}/problems.json"
    with open(at, "w") as f:
        json.dump({"problems": [{"name": r.n_name, "path": f"/data/{r.n_nationkey}"} for r in rows]}, f)
    return readers.read_problems(spark, f"file://{at}")


@query("SELECT CAST(k AS INT) AS frame, 0.5 + k * 0.25 AS time, format('/d/run/run_t{:06d}.bin', k) AS path FROM (SELECT unnest(generate_series(0, 6)) AS k) t")
def frame_files(spark, d):
    """Time steps and the files of their frames."""
    rows = [(i, t, readers.frame_file("/d/run.bin", i)) for i, t in enumerate(readers.times(0.5, 2.0, 7))]
    return spark.createDataFrame(rows, "frame int, time double, path string")


@query(with_views("pts2", body="SELECT id, x + frame / 4.0 AS x, CAST(frame AS INT) AS frame FROM pts2, (SELECT unnest(generate_series(0, 2)) AS frame) t"))
def animated_points_pts2(spark, d):
    """Every point at every time step."""
    rows = readers.with_times(pts2(spark, d).select("id", "x"), readers.times(0.0, 0.5, 3))
    return rows.select("id", (F.col("x") + F.col("time")).alias("x"), "frame")


@query(with_views("grid2", body="SELECT ix, iy, -v AS v FROM grid2"))
def swapped_frame_grid2(spark, d):
    """A frame put in the place of another one."""
    at = f"file://{folder(spark, 'frame')}/pixels"
    g = grid2(spark, d).select("ix", "iy", "v")
    writers.swap_in(g, at)
    writers.swap_in(g.withColumn("v", -F.col("v")), at)
    return writers.read_swapped(spark, at)


@query(with_views("tele", body="SELECT k || '=' || CAST(v AS VARCHAR) AS value FROM (SELECT 'frames' AS k, count(DISTINCT frame) AS v FROM tele UNION ALL SELECT 'rows', count(*) FROM tele) t"))
def key_values_tele(spark, d):
    row = tele(spark, d).agg(F.count_distinct("frame").alias("frames"), F.count("*").alias("rows")).first()
    return spark.createDataFrame([(x,) for x in writers.key_values(row.asDict()).splitlines()], "value string")


@query("SELECT concat('  \"r', CAST(r_regionkey AS VARCHAR), '\" -> \"n', CAST(n_nationkey AS VARCHAR), '\";') AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_dot_nation(spark, d):
    """A graph's edges as DOT text."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    text = writers.graph_dot(n.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("from"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("to")))
    return spark.createDataFrame([(x,) for x in text.splitlines()[1:-1]], "value string")


@query(with_views("elem2", body="""+f AS (SELECT element_id, n0 % 17 AS i, n0 // 17 AS j FROM elem2),
e AS (SELECT element_id, 0 AS face, i AS x0, j + 1 AS y0, i AS x1, j AS y1 FROM f WHERE i = 0 UNION ALL SELECT element_id, 1, i + 1, j, i + 1, j + 1 FROM f WHERE i = 15
UNION ALL SELECT element_id, 2, i, j, i + 1, j FROM f WHERE j = 0 UNION ALL SELECT element_id, 3, i + 1, j + 1, i, j + 1 FROM f WHERE j = 15)
SELECT element_id, CAST(face AS INT) AS face, 0 AS pos, CAST(x0 AS DOUBLE) AS x, CAST(y0 AS DOUBLE) AS y FROM e UNION ALL SELECT element_id, CAST(face AS INT), 1, CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE) FROM e"""))
def boundary_text_grid2(spark, d):
    """Boundary faces with their corners as text."""
    at = f"file://{folder(spark, 'boundary')}"
    writers.boundary_text(mesh.boundary_faces(mesh.structured_elements(spark, [17, 17])), grid2(spark, d), 2, at)
    p = F.split("value", "\t")
    return spark.read.text(at).select(F.get(p, F.lit(0)).cast("long").alias("element_id"), *(F.get(p, F.lit(i)).cast("int").alias(n) for i, n in ((1, "face"), (2, "pos"))), *(F.get(p, F.lit(i)).cast("double").alias(n) for i, n in ((3, "x"), (4, "y"))))


@query(with_views("tele", body="SELECT stage, CAST(count(*) AS BIGINT) AS n FROM tele WHERE level = 1 AND node = 2 GROUP BY stage"))
def stage_counts_tele(spark, d):
    """Rows of one level and node by stage."""
    return telemetry.of_level(tele(spark, d), level=1, node=2).groupBy("stage").agg(F.count("*").alias("n"))
