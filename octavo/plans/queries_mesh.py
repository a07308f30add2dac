"""Registered queries of the preparation of meshes and points, and of functions that the others leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octavo.functions import boxes, cells, colors, vectors
from octavo.functions.cells import Cube
from octavo.operators import dense, fields, interpolate, mesh, order, tree, view
from octavo.plans import prepare
from octavo.plans import view as plan
from octavo.plans.adapters import emb3, grid2, img2, pts2, pts3, rays, rounded, with_views
from octavo.plans.registry import query


def elements2(spark: SparkSession) -> DataFrame:
    return mesh.structured_elements(spark, [17, 17])


def r6(c) -> F.Column:
    return F.round(c, 6)


# -- elements: refinement, boundary, tree ---------------------------------------------------------

# The lattice, sheared and stretched: a's edges have length 3, b's the square root of 1.25.
SKEW = "+sk AS (SELECT node_id, 3 * x + 0.5 * y AS x, y AS y, v FROM grid2), "
CORNERS = """k AS (SELECT e.element_id, a.x AS ax, a.y AS ay, a.v AS av, b.x AS bx, b.y AS b_y, b.v AS bv, c.x AS cx, c.y AS cy, c.v AS cv, d.x AS dx, d.y AS dy, d.v AS dv
FROM elem2 e JOIN sk a ON a.node_id = n0 JOIN sk b ON b.node_id = n1 JOIN sk c ON c.node_id = n2 JOIN sk d ON d.node_id = n3),
l AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS lx, sqrt((dx - ax) * (dx - ax) + (dy - ay) * (dy - ay)) AS ly FROM k),
s AS (SELECT *, least(lx, ly) + 0.25 * (greatest(lx, ly) - least(lx, ly)) AS size FROM l),
n AS (SELECT *, greatest(CAST(floor(lx / size + 0.5) AS INT), 1) AS nx, greatest(CAST(floor(ly / size + 0.5) AS INT), 1) AS ny FROM s),
r AS (SELECT *, i / CAST(nx AS DOUBLE) AS t, j / CAST(ny AS DOUBLE) AS u FROM n, (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS i) p, (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS j) q WHERE i <= nx AND j <= ny)"""


def skewed(spark: SparkSession, d: str) -> DataFrame:
    return grid2(spark, d).select("zone_id", "node_id", (3 * F.col("x") + 0.5 * F.col("y")).alias("x"), "y", "v")


@query(with_views("elem2", "grid2", body=SKEW + CORNERS + """ SELECT element_id, i AS i_x, j AS i_y, round(size, 6) AS size,
round((1 - t) * (1 - u) * ax + t * (1 - u) * bx + t * u * cx + (1 - t) * u * dx, 6) AS x, round((1 - t) * (1 - u) * ay + t * (1 - u) * b_y + t * u * cy + (1 - t) * u * dy, 6) AS y,
round((1 - t) * (1 - u) * av + t * (1 - u) * bv + t * u * cv + (1 - t) * u * dv, 4) AS v FROM r"""))
def refined_skewed_grid2(spark, d):
    """Elements that are no boxes: places and values along their own edges."""
    r = mesh.refined(elements2(spark), skewed(spark, d), 2, 0.25, ("v",))
    return r.select("element_id", "i_x", "i_y", r6(F.col("size")).alias("size"), r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), F.round("v", 4).alias("v"))


@query(with_views("grid2", body="SELECT node_id, x, y, v FROM grid2 WHERE ix < 16 AND iy < 16 UNION ALL SELECT node_id, x, y, v FROM grid2 WHERE ix > 0 AND iy < 16 UNION ALL SELECT node_id, x, y, v FROM grid2 WHERE ix > 0 AND iy > 0"))
def refined_triangles_grid2(spark, d):
    """Elements that lack a node give the nodes that they have."""
    e = elements2(spark).withColumn("nodes", F.concat(F.slice("nodes", 1, 3), F.array(F.lit(None).cast("long"))))
    r = mesh.refined(e, grid2(spark, d), 2, 0.5, ("v",))
    return r.select((F.col("y") * 17 + F.col("x")).cast("long").alias("node_id"), "x", "y", "v")


#: Boundary points of the lattice of unit quads: two of each boundary face, with its normal.
EDGES = """b AS (SELECT i, 0 AS s FROM (SELECT unnest(generate_series(0, 15)) AS i) t), bp AS (
SELECT 0.0::DOUBLE AS x, CAST(i + k AS DOUBLE) AS y, -1.0::DOUBLE AS n_x, 0.0::DOUBLE AS n_y FROM b, (SELECT unnest([0, 1]) AS k) q UNION ALL SELECT 16, i + k, 1, 0 FROM b, (SELECT unnest([0, 1]) AS k) q
UNION ALL SELECT i + k, 0, 0, -1 FROM b, (SELECT unnest([0, 1]) AS k) q UNION ALL SELECT i + k, 16, 0, 1 FROM b, (SELECT unnest([0, 1]) AS k) q)"""


def edge2(spark: SparkSession, d: str) -> DataFrame:
    e, g = elements2(spark), grid2(spark, d)
    return mesh.boundary_points(mesh.boundary_faces(e), g, 2, 1, mesh.element_shapes(e, g, 2, 1.0))


@query(f"WITH {EDGES} SELECT x, y, n_x, n_y, 1.0::DOUBLE AS size FROM bp")
def boundary_points_grid2(spark, d):
    return edge2(spark, d).select("x", "y", "n_x", "n_y", "size")


@query("SELECT -1.0::DOUBLE AS min_x, 17.0::DOUBLE AS max_x, -1.0::DOUBLE AS min_y, 17.0::DOUBLE AS max_y")
def inflated_bounds_grid2(spark, d):
    """The bounds that also hold the boundary moved outward by one element."""
    return mesh.inflated(cells.bounds(grid2(spark, d), 2), edge2(spark, d), 2)


#: The tree of the lattice's elements in the cube [-1, 17]^2: nodes at the level of size 1 (4), the boundary one level above at three places.
TREE = f"""{EDGES}, cl AS (SELECT CAST(greatest(least(ceil((x + 1) / 18 * 16) - 1, 15), 0) AS INT) AS ix, CAST(greatest(least(ceil((y + 1) / 18 * 16) - 1, 15), 0) AS INT) AS iy, 4 AS level FROM (SELECT CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y FROM (SELECT unnest(generate_series(0, 16)) AS i) p, (SELECT unnest(generate_series(0, 16)) AS j) q) t
UNION SELECT CAST(greatest(least(ceil((x + h * n_x + 1) / 18 * 8) - 1, 7), 0) AS INT), CAST(greatest(least(ceil((y + h * n_y + 1) / 18 * 8) - 1, 7), 0) AS INT), 3 FROM bp, (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, -0.5::DOUBLE]) AS h) q),
mb AS (SELECT DISTINCT CAST(l AS INT) AS level, ix >> (level - CAST(l AS INT)) AS ix, iy >> (level - CAST(l AS INT)) AS iy FROM cl, (SELECT unnest(generate_series(0, 4)) AS l) t WHERE l <= level),
mh AS (SELECT a.level, a.ix, a.iy, CAST(max(b.level) - a.level AS INT) AS height FROM mb a JOIN mb b ON b.level >= a.level AND (b.ix >> (b.level - a.level)) = a.ix AND (b.iy >> (b.level - a.level)) = a.iy GROUP BY a.level, a.ix, a.iy),
ms AS (SELECT level, ix, iy, least(height, 2) AS depth FROM mh WHERE level <= 0 OR height >= 2),
mm AS (SELECT s.*, b.level AS bl, b.ix AS bx, b.iy AS b_y FROM ms s JOIN mb b ON b.level >= s.level AND b.level - s.level <= s.depth AND (b.ix >> (b.level - s.level)) = s.ix AND (b.iy >> (b.level - s.level)) = s.iy),
mc AS (SELECT *, depth - (bl - level) AS sh, c FROM mm, (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS c) t),
mn AS (SELECT DISTINCT level, ix, iy, depth, ((bx << sh) & ((1 << depth) - 1)) + ((c & 1) << sh) AS nx, ((b_y << sh) & ((1 << depth) - 1)) + ((c >> 1) << sh) AS ny FROM mc),
mp AS (SELECT *, -1 + 18.0::DOUBLE / (1 << level) * (ix + nx / CAST(1 << depth AS DOUBLE)) AS x, -1 + 18.0::DOUBLE / (1 << level) * (iy + ny / CAST(1 << depth AS DOUBLE)) AS y FROM mn)"""


def _mesh2(spark: SparkSession, d: str, boundary: bool = False) -> prepare.PreparedMesh:
    return prepare.mesh_problem(elements2(spark), grid2(spark, d), 2, 2, 4, boundary=boundary)


@query(f"WITH {TREE} SELECT level, ix, iy FROM mb")
def mesh_tree_grid2(spark, d):
    """The tree of a mesh: blocks by the size of its elements, and around its boundary."""
    return _mesh2(spark, d).blocks.select("level", "ix", "iy")


@query(f"WITH {TREE} SELECT level, ix, iy, depth FROM ms")
def mesh_subtrees_grid2(spark, d):
    return _mesh2(spark, d).subtrees.select("level", "ix", "iy", "depth")


@query(with_views("grid2", body=f"""+{TREE}, c AS (SELECT *, least(floor(x), 15) AS fx, least(floor(y), 15) AS fy FROM mp WHERE x >= -1e-9 AND x <= 16 + 1e-9 AND y >= -1e-9 AND y <= 16 + 1e-9),
w AS (SELECT c.*, f, (CASE WHEN a = 1 THEN c.x - fx ELSE 1 - (c.x - fx) END) * (CASE WHEN b = 1 THEN c.y - fy ELSE 1 - (c.y - fy) END) * (CASE WHEN f = 'w' THEN 2 * v + 1 ELSE v END) AS p
FROM c, (SELECT unnest([0, 1]) AS a) p, (SELECT unnest([0, 1]) AS b) q, (SELECT unnest(['v', 'w']) AS f) r, grid2 g WHERE g.ix = fx + a AND g.iy = fy + b)
SELECT f AS field, level, ix, iy, nx, ny, round(sum(p) / 100, 3) AS value FROM w GROUP BY ALL"""))
def mesh_fields_grid2(spark, d):
    """Two fields of a mesh at the nodes of all stored subtrees: element interpolation, rolled up from the deepest level."""
    made = _mesh2(spark, d)
    each = F.explode(F.array(F.struct(F.lit("v").alias("field"), F.col("v").alias("v")), F.struct(F.lit("w").alias("field"), (2 * F.col("v") + 1).alias("v"))))
    values = grid2(spark, d).select("zone_id", "node_id", each.alias("_f")).select("zone_id", "node_id", "_f.field", F.lit(0).alias("frame"), "_f.v")
    out = prepare.mesh_fields(made, values, 2)
    return out.select("field", "level", "ix", "iy", "nx", "ny", rounded(F.col("value") / 100, 3).alias("value"))


@query(with_views("grid2", body=f"""+{TREE}, pt AS (SELECT row_number() OVER () AS id, * FROM bp),
q AS (SELECT pt.*, x + s * n_x AS qx, y + s * n_y AS qy FROM pt, (SELECT unnest([-1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE]) AS s) t),
d AS (SELECT q.*, max(mb.level) AS dl FROM q JOIN mb ON mb.ix = CAST(greatest(least(ceil((qx + 1) / 18 * 16) - 1, 15), 0) AS INT) >> (4 - mb.level) AND mb.iy = CAST(greatest(least(ceil((qy + 1) / 18 * 16) - 1, 15), 0) AS INT) >> (4 - mb.level) GROUP BY ALL),
e AS (SELECT DISTINCT d.id, d.x, d.y, d.n_x, d.n_y, ms.level, ms.ix, ms.iy, ms.depth, least(dl, ms.level + ms.depth) AS cut,
CAST(greatest(least(ceil((qx + 1) / 18 * 16) - 1, 15), 0) AS INT) >> (4 - least(dl, ms.level + ms.depth)) AS bx, CAST(greatest(least(ceil((qy + 1) / 18 * 16) - 1, 15), 0) AS INT) >> (4 - least(dl, ms.level + ms.depth)) AS b_y
FROM d JOIN ms ON ms.level <= dl AND ms.ix = CAST(greatest(least(ceil((qx + 1) / 18 * 16) - 1, 15), 0) AS INT) >> (4 - ms.level) AND ms.iy = CAST(greatest(least(ceil((qy + 1) / 18 * 16) - 1, 15), 0) AS INT) >> (4 - ms.level)),
f AS (SELECT e.*, a, b, n_x * (-1 + 18.0::DOUBLE / (1 << cut) * (bx + a) - x) + n_y * (-1 + 18.0::DOUBLE / (1 << cut) * (b_y + b) - y) AS dist FROM e, (SELECT CAST(unnest([0, 1]) AS INT) AS a) p, (SELECT CAST(unnest([0, 1]) AS INT) AS b) q),
m AS (SELECT level, ix, iy, depth, ((bx << (depth - (cut - level))) & ((1 << depth) - 1)) + (a << (depth - (cut - level))) AS nx, ((b_y << (depth - (cut - level))) & ((1 << depth) - 1)) + (b << (depth - (cut - level))) AS ny, avg(dist) AS dist FROM f GROUP BY ALL),
z AS (SELECT level, ix, iy, greatest(max(dist), 0) AS hi, greatest(-min(dist), 0) AS lo FROM m GROUP BY ALL)
SELECT m.level, m.ix, m.iy, nx, ny, round(CASE WHEN hi > 0 AND lo > 0 THEN CASE WHEN dist > 0 THEN dist / hi ELSE dist / lo END ELSE dist END, 4) AS value FROM m JOIN z USING (level, ix, iy)"""))
def mesh_shape_grid2(spark, d):
    """The boundary's signed distance at the nodes of stored subtrees."""
    return _mesh2(spark, d, boundary=True).shape.select("level", "ix", "iy", "nx", "ny", F.round("value", 4).alias("value"))


@query(with_views("elem2", "grid2", body="""+r AS (SELECT n0 % 17 + i / 2.0::DOUBLE AS x, n0 // 17 + j / 2.0::DOUBLE AS y, ((1 - i / 2.0::DOUBLE) * (1 - j / 2.0::DOUBLE) * a.v + i / 2.0::DOUBLE * (1 - j / 2.0::DOUBLE) * b.v + i / 2.0::DOUBLE * (j / 2.0::DOUBLE) * c.v + (1 - i / 2.0::DOUBLE) * (j / 2.0::DOUBLE) * e.v) AS v
FROM elem2, (SELECT unnest([0, 2]) AS i) p, (SELECT unnest([0, 2]) AS j) q, grid2 a, grid2 b, grid2 c, grid2 e WHERE a.node_id = n0 AND b.node_id = n1 AND c.node_id = n2 AND e.node_id = n3),
p AS (SELECT *, CAST(greatest(least(ceil(x / 16 * 8) - 1, 7), 0) AS INT) AS ix, CAST(greatest(least(ceil(y / 16 * 8) - 1, 7), 0) AS INT) AS iy FROM r), t AS (SELECT *, x / 2 - ix AS tx, y / 2 - iy AS ty FROM p),
w AS (SELECT ix + (c & 1) AS nx, iy + (c >> 1) AS ny, v, greatest((CASE WHEN c & 1 = 1 THEN tx ELSE 1 - tx END) * (CASE WHEN c >> 1 = 1 THEN ty ELSE 1 - ty END), 2e-5) AS w FROM t, (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS c) q)
SELECT nx, ny, round(sum(v * w) / sum(w) / 100, 3) AS value FROM w GROUP BY nx, ny"""))
def refined_scatter_grid2(spark, d):
    """The weighted mean over the refined elements' points on the corners of level 3."""
    points = interpolate.refined_points(elements2(spark), grid2(spark, d), "v", 2, 1.0)
    return fields.corner_mean(points, Cube((0.0, 0.0), 16.0), 3, "v").select("nx", "ny", F.round(F.col("value") / 100, 3).alias("value"))


# -- whole problems ---------------------------------------------------------------------------------

POINTS3 = """+c AS (SELECT *, CAST(greatest(least(ceil((x - mx) / s * 8) - 1, 7), 0) AS INT) AS ix, CAST(greatest(least(ceil((y - my) / s * 8) - 1, 7), 0) AS INT) AS iy, CAST(greatest(least(ceil((z - mz) / s * 8) - 1, 7), 0) AS INT) AS iz FROM pts3, cube3),
t AS (SELECT c.*, l, ix >> (3 - l) AS bx, iy >> (3 - l) AS b_y, iz >> (3 - l) AS bz FROM c, (SELECT CAST(unnest([2, 3]) AS INT) AS l) q),
u AS (SELECT *, (x - mx) / s * (1 << l) - bx AS tx, (y - my) / s * (1 << l) - b_y AS ty, (z - mz) / s * (1 << l) - bz AS tz FROM t),
w AS (SELECT l - 2 AS level, bx >> 2 AS ix, b_y >> 2 AS iy, bz >> 2 AS iz, (bx & 3) + (k & 1) AS nx, (b_y & 3) + ((k >> 1) & 1) AS ny, (bz & 3) + (k >> 2) AS nz, v,
greatest((CASE WHEN k & 1 = 1 THEN tx ELSE 1 - tx END) * (CASE WHEN (k >> 1) & 1 = 1 THEN ty ELSE 1 - ty END) * (CASE WHEN k >> 2 = 1 THEN tz ELSE 1 - tz END), 2e-5) AS w FROM u, (SELECT CAST(unnest(generate_series(0, 7)) AS INT) AS k) q),
own AS (SELECT level, ix, iy, iz, nx, ny, nz, CASE WHEN sum(w) >= 1e-5 THEN sum(v * w) / sum(w) END AS value FROM w GROUP BY ALL),
kids AS (SELECT ix * 2 + nx // 2 AS nx, iy * 2 + ny // 2 AS ny, iz * 2 + nz // 2 AS nz, avg(value) AS value FROM own WHERE level = 1 AND nx % 2 = 0 AND ny % 2 = 0 AND nz % 2 = 0 GROUP BY ALL),
n AS (SELECT count(DISTINCT (ix, iy, iz)) AS n FROM own WHERE level = 1),
top AS (SELECT * FROM own, n WHERE level = 0 AND n < 8)
SELECT level, ix, iy, iz, 2 AS depth, nx, ny, nz, round(value / 100, 3) AS value FROM own WHERE level = 1
UNION ALL SELECT 0, 0, 0, 0, 2, coalesce(kids.nx, top.nx), coalesce(kids.ny, top.ny), coalesce(kids.nz, top.nz), round(coalesce(kids.value, top.value) / 100, 3) FROM kids FULL JOIN top ON kids.nx = top.nx AND kids.ny = top.ny AND kids.nz = top.nz"""


@query(with_views("pts3", "cube3", body=POINTS3))
def points_problem_pts3(spark, d):
    """The whole preparation of scattered points: tree, stored subtrees, weighted means, roll-up."""
    made = prepare.points_problem(pts3(spark, d), 3, "v", 3, 2).sparse
    return made.withColumn("value", F.round(F.col("value") / 100, 3))


@query("""WITH r AS (SELECT unnest([(0, 0, 0, 0), (1, 0, 0, 0), (1, 1, 0, 0), (1, 0, 1, 0), (1, 1, 1, 0), (1, 0, 0, 1), (1, 1, 0, 1), (1, 0, 1, 1), (1, 1, 1, 1)]) AS k),
n AS (SELECT k[1] AS level, k[2] AS ix, k[3] AS iy, k[4] AS iz, CAST(a AS INT) AS nx, CAST(b AS INT) AS ny, CAST(c AS INT) AS nz, CAST(f AS INT) AS frame FROM r, (SELECT unnest(generate_series(0, 4)) AS a) p, (SELECT unnest(generate_series(0, 4)) AS b) q, (SELECT unnest(generate_series(0, 4)) AS c) s, (SELECT unnest([0, 1]) AS f) t),
p AS (SELECT *, -1 + 2.0::DOUBLE / (1 << level) * (ix + nx / 4.0::DOUBLE) AS x, -1 + 2.0::DOUBLE / (1 << level) * (iy + ny / 4.0::DOUBLE) AS y, 0.1 + 2.0::DOUBLE / (1 << level) * (iz + nz / 4.0::DOUBLE) AS z FROM n),
w AS (SELECT *, cos(0.5 * pi() * z) * x + sin(0.5 * pi() * z) * y AS a, -sin(0.5 * pi() * z) * x + cos(0.5 * pi() * z) * y AS b FROM p)
SELECT level, ix, iy, iz, 2 AS depth, nx, ny, nz, frame, round(sin(pi() * a / z) * sin(pi() * b / z) * sin(1 / z + pi() * frame) - z, 5) AS value FROM w""")
def exact_problem_waves(spark, d):
    """An analytic function on a full tree, at two times."""
    config = prepare.ExactConfig.merged('{"cell_count": {"x": 8, "y": 8, "z": 8}}', time_step_count=2, domain={"min": {"x": -1, "y": -1, "z": 0.1}, "max": {"x": 1, "y": 1, "z": 2.1}})
    return prepare.exact_problem(spark, config, 3, 2, 3).sparse.withColumn("value", F.round("value", 5))


IMAGE = """+k AS (SELECT ix, iy, v, n % 2 = 0 AS inside FROM img2), b AS (SELECT DISTINCT 4 - CAST(h AS INT) AS level, ix >> CAST(h AS INT) AS ix, iy >> CAST(h AS INT) AS iy FROM k, (SELECT unnest(generate_series(0, 4)) AS h) t WHERE inside),
d AS (SELECT k.ix, k.iy, k.v, k.inside, max(b.level) AS dl FROM k JOIN b ON b.ix = k.ix >> (4 - b.level) AND b.iy = k.iy >> (4 - b.level) GROUP BY ALL),
f AS (SELECT *, 'shape' AS field, CASE WHEN inside THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS val FROM d UNION ALL SELECT *, 'v', v FROM d WHERE inside),
s AS (SELECT level, ix, iy FROM b WHERE level <= 2),
e AS (SELECT f.*, s.level, s.ix AS sx, s.iy AS sy, least(dl, s.level + 2) AS cut FROM f JOIN s ON s.level <= dl AND s.ix = f.ix >> (4 - s.level) AND s.iy = f.iy >> (4 - s.level)),
t AS (SELECT *, ix >> (4 - cut) AS bx, iy >> (4 - cut) AS b_y FROM e), u AS (SELECT *, (ix + 0.5::DOUBLE) / (1 << (4 - cut)) - bx AS tx, (iy + 0.5::DOUBLE) / (1 << (4 - cut)) - b_y AS ty FROM t),
w AS (SELECT field, level, sx, sy, ((bx << (2 - (cut - level))) & 3) + ((c & 1) << (2 - (cut - level))) AS nx, ((b_y << (2 - (cut - level))) & 3) + ((c >> 1) << (2 - (cut - level))) AS ny, val,
greatest((CASE WHEN c & 1 = 1 THEN tx ELSE 1 - tx END) * (CASE WHEN c >> 1 = 1 THEN ty ELSE 1 - ty END), 2e-5) AS w FROM u, (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS c) q),
own AS (SELECT field, level, sx, sy, nx, ny, sum(val * w) / sum(w) AS value FROM w GROUP BY ALL),
whole AS (SELECT level - 1 AS level, ix >> 1 AS sx, iy >> 1 AS sy FROM s WHERE level > 0 GROUP BY ALL HAVING count(*) = 4),
k1 AS (SELECT field, 1 AS level, sx >> 1 AS sx, sy >> 1 AS sy, nx // 2 + (sx & 1) * 2 AS nx, ny // 2 + (sy & 1) * 2 AS ny, avg(value) AS value FROM own WHERE level = 2 AND nx % 2 = 0 AND ny % 2 = 0 GROUP BY ALL),
o1 AS (SELECT own.* FROM own LEFT JOIN whole USING (level, sx, sy) WHERE own.level = 1 AND whole.sx IS NULL),
v1 AS (SELECT coalesce(a.field, o.field) AS field, 1 AS level, coalesce(a.sx, o.sx) AS sx, coalesce(a.sy, o.sy) AS sy, coalesce(a.nx, o.nx) AS nx, coalesce(a.ny, o.ny) AS ny, coalesce(a.value, o.value) AS value FROM k1 a FULL JOIN o1 o ON a.field = o.field AND a.sx = o.sx AND a.sy = o.sy AND a.nx = o.nx AND a.ny = o.ny),
k0 AS (SELECT field, 0 AS level, sx >> 1 AS sx, sy >> 1 AS sy, nx // 2 + (sx & 1) * 2 AS nx, ny // 2 + (sy & 1) * 2 AS ny, avg(value) AS value FROM v1 WHERE nx % 2 = 0 AND ny % 2 = 0 GROUP BY ALL),
o0 AS (SELECT own.* FROM own LEFT JOIN whole USING (level, sx, sy) WHERE own.level = 0 AND whole.sx IS NULL),
v0 AS (SELECT coalesce(a.field, o.field) AS field, 0 AS level, 0 AS sx, 0 AS sy, coalesce(a.nx, o.nx) AS nx, coalesce(a.ny, o.ny) AS ny, coalesce(a.value, o.value) AS value FROM k0 a FULL JOIN o0 o ON a.field = o.field AND a.nx = o.nx AND a.ny = o.ny)
SELECT field, level, sx AS ix, sy AS iy, nx, ny, round(value, 3) AS value FROM (SELECT field, level, sx, sy, nx, ny, value FROM own WHERE level = 2 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v0) t"""


@query(with_views("img2", body=IMAGE))
def image_problem_img2(spark, d):
    """Voxels of a domain: its shape and a field, at the nodes of stored subtrees, rolled up."""
    made = prepare.image_problem(img2(spark, d), 2, F.col("n") % 2 == 0, ["v"], 2, 4, [16, 16]).sparse
    return made.where("field in ('shape', 'v')").select("field", "level", "ix", "iy", "nx", "ny", F.round("value", 3).alias("value"))


# -- functions -----------------------------------------------------------------------------------------

@query(with_views("emb3", body="""SELECT id, round(y, 4) AS cw_x, round(-x, 4) AS cw_y, round(-y, 4) AS ccw_x, round(x, 4) AS ccw_y, CASE WHEN (CASE WHEN abs(x) >= greatest(abs(y), abs(z)) THEN x WHEN abs(y) >= abs(z) THEN y ELSE z END) < 0 THEN -1 ELSE 1 END AS orientation,
round(x * 2 - y, 4) AS cross2, round(least(greatest(x, -0.5), 0.5), 4) AS clamped, round(-0.25 + 0.5 * least(greatest(x, -0.5), 0.5), 4) AS at_level, abs(x) < 0 AS zero FROM emb3"""))
def vector_more_emb3(spark, d):
    """Quarter turns, orientation, the plane's cross product, cut and relative levels."""
    p = emb3(spark, d)
    v = [p["x"], p["y"], p["z"]]
    cw, ccw = vectors.rotate_cw(v[:2]), vectors.rotate_ccw(v[:2])
    cut = vectors.clamp(p["x"], -0.5, 0.5)
    out = {"cw_x": cw[0], "cw_y": cw[1], "ccw_x": ccw[0], "ccw_y": ccw[1], "cross2": vectors.cross2(v[:2], [F.lit(1.0), F.lit(2.0)]), "clamped": cut, "at_level": colors.absolute_level(F.lit(-0.25), F.lit(0.25), cut)}
    return p.select("id", *(F.round(c, 4).alias(n) for n, c in out.items()), vectors.orientation(v).alias("orientation"), vectors.is_zero([F.lit(1.0), p["x"]]).alias("zero"))


@query(with_views("pts2", body="SELECT id, CAST(x AS INT) << 2 AS l, CAST(x AS INT) >> 1 AS r, CAST(x AS INT) & 5 AS a, CAST(x AS INT) | 5 AS o, CASE WHEN id % 2 = 0 THEN CAST(x AS INT) >> 1 ELSE CAST(x AS INT) << 1 END AS signed, CAST(17 * 17 AS INT) AS vertices, CAST(256 AS INT) AS blocks, CAST(bit_count((CAST(x AS INT) & 255) >> 5) AS INT) AS high FROM pts2"))
def index_shifts_pts2(spark, d):
    """Shifts and masks of index vectors, sizes of a level's lattice, ones among the highest bits."""
    p = pts2(spark, d).withColumn("i", F.col("x").cast("int"))
    one = lambda f, n: f([F.col("i")], n)[0]
    signed = vectors.signed_shift_right(F.col("i"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1))
    high = cells.pop_count_high(F.col("i").bitwiseAND(F.lit(255)), 8, F.lit(3)).cast("int")
    return p.select("id", one(vectors.shift_left, 2).alias("l"), one(vectors.shift_right, 1).alias("r"), one(vectors.bit_and, 5).alias("a"), one(vectors.bit_or, 5).alias("o"), signed.alias("signed"), F.lit(cells.vertex_count(4, 2)).alias("vertices"), F.lit(cells.block_count(4, 2)).alias("blocks"), high.alias("high"))


@query(with_views("emb3", body="""+m AS (SELECT id, x, y, z, 4 + x AS a, 1.0::DOUBLE AS b, y AS c, z AS e, 5 + y AS f, 1.0::DOUBLE AS g, 1.0::DOUBLE AS h, x AS i, 6 + z AS j FROM emb3),
t AS (SELECT *, a * (f * j - g * i) - b * (e * j - g * h) + c * (e * i - f * h) AS det FROM m)
SELECT id, round(a * p + b * q + c * r, 3) AS r1, round(e * p + f * q + g * r, 3) AS r2, round(h * p + i * q + j * r, 3) AS r3 FROM (SELECT *, x AS p, y AS q, z AS r FROM t) u"""))
def cramer3_emb3(spark, d):
    """Three equations solved for vectors whose image is known: the matrix of the solution gives the right side again."""
    p = emb3(spark, d)
    x, y, z, one = p["x"], p["y"], p["z"], F.lit(1.0)
    m = [[4 + x, one, y], [z, 5 + y, one], [one, x, 6 + z]]
    image = [vectors.dot(row, [x, y, z]) for row in m]
    back = vectors.solve3(m, image)
    again = [vectors.dot(row, back) for row in m]
    return p.select("id", *(F.round(c, 3).alias(f"r{i + 1}") for i, c in enumerate(again)))


@query(with_views("emb3", body="""+t AS (SELECT id, abs(x) / 4 AS a, abs(y) / 4 AS b, abs(z) / 4 AS c, x AS ox, y AS oy, z AS oz FROM emb3)
SELECT id, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c, a + b + c <= 1 AS inside, round((1 - a - b - c) * 10 + a * 20 + b * 30 + c * 40, 3) AS value FROM t"""))
def tetrahedron_emb3(spark, d):
    """Barycentric weights of points given by them, in a tetrahedron that depends on the vector."""
    p = emb3(spark, d)
    w = [F.abs(p[c]) / 4 for c in "xyz"]
    o = [p["x"], p["y"], p["z"]]
    corners = [o, *([o[i] + s * (F.lit(1.0 + k) if i == k else F.lit(0.25)) for i in range(3)] for k, s in enumerate((1.0, 1.0, 1.0)))]
    point = [o[i] + sum(w[k] * (corners[k + 1][i] - o[i]) for k in range(3)) for i in range(3)]
    found = vectors.tetrahedron_barycentric(point, *corners)
    inside = sum((x for x in w[1:]), w[0]) <= 1
    return p.select("id", *(F.round(x, 4).alias(n) for n, x in zip("abc", found, strict=True)), inside.alias("inside"), F.round(vectors.simplex_interpolate(found, [F.lit(float(v)) for v in (10, 20, 30, 40)]), 3).alias("value"))


@query(with_views("emb3", body="""+n AS (SELECT id, y * 2 - z AS a, z - x * 2 AS b, x - y AS c FROM emb3), l AS (SELECT *, sqrt(a * a + b * b + c * c) AS l FROM n)
SELECT id, round(a / l, 4) AS n_x, round(b / l, 4) AS n_y, round(c / l, 4) AS n_z FROM l WHERE l > 0"""))
def face_normal_emb3(spark, d):
    """The unit normal of the triangle of the origin, the vector and (1, 1, 2)."""
    p = emb3(spark, d)
    zero = [F.lit(0.0)] * 3
    n = vectors.face_normal([zero, [p["x"], p["y"], p["z"]], [F.lit(1.0), F.lit(1.0), F.lit(2.0)]])
    return p.select("id", *(F.round(c, 4).alias(f"n_{a}") for a, c in zip("xyz", n, strict=True)))


@query(with_views("pts2", body="""SELECT id, greatest(x - 10, y - 20) AS big, CASE WHEN x > 10 AND y > 20 THEN least(x - 10, y - 20) WHEN x > 10 THEN x - 10 WHEN y > 20 THEN y - 20 END AS small, (x - 10 + y - 20) / 2 AS mean,
greatest(10, 15) <= least(x, 40) AND greatest(20, 25) <= least(y, 60) AS meets, x - 5 AS moved FROM pts2"""))
def box_sizes_pts2(spark, d):
    """Sizes of the box from (10, 20) to the point, its meeting with another one, and the box moved."""
    p = pts2(spark, d)
    box = ([F.lit(10.0), F.lit(20.0)], [p["x"], p["y"]])
    other = ([F.lit(15.0), F.lit(25.0)], [F.lit(40.0), F.lit(60.0)])
    meets = ~boxes.is_empty(boxes.intersection(box, other))
    return p.select("id", boxes.size_max(box).alias("big"), boxes.size_min_positive(box).alias("small"), boxes.size_average(box).alias("mean"), meets.alias("meets"), boxes.offset(box, [F.lit(-5.0), F.lit(0.0)])[1][0].alias("moved"))


@query(with_views("img2", body="SELECT ix, iy, least(ix // 4 * 4, 13) AS x0, least(ix // 4 * 4 + 4, 13) AS x1 FROM img2"))
def image_range_img2(spark, d):
    """The voxels along x of the level-2 block that holds a voxel, in an image of 13 voxels."""
    lo, hi = cells.image_range(F.floor(F.col("ix") / 4).cast("int"), 2, 4, 13)
    return img2(spark, d).select("ix", "iy", lo.alias("x0"), hi.alias("x1"))


# -- order ------------------------------------------------------------------------------------------------

@query("SELECT * FROM (VALUES (0, 0, 1, 0, 2, 0, 2), (1, 1, 2, 0, 2, 0, 2), (2, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0)) t(n, x0, x1, y0, y1, z0, z1)")
def padded_split(spark, d):
    """The level-1 cube in two boxes, with empty ones up to four."""
    found = order.padded(order.split_cube(1, 2), 4)
    return spark.createDataFrame([(i, a[0], b[0], a[1], b[1], a[2], b[2]) for i, (a, b) in enumerate(found)], "n int, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int")


@query("""WITH b AS (SELECT CAST(x AS INT) AS x0, CAST(y AS INT) AS y0, CAST(z AS INT) AS z0 FROM (SELECT unnest([0, 1]) AS x) a, (SELECT unnest([0, 1]) AS y) c, (SELECT unnest([0, 1]) AS z) d)
SELECT CAST(row_number() OVER (ORDER BY 3 - x0 - y0 - z0, 1 - z0, 1 - y0) - 1 AS INT) AS n, x0, y0, z0 FROM b""")
def sorted_split(spark, d):
    """The level-1 cube in eight boxes, seen from beyond its lowest corner: the farthest box first, the nearest last."""
    found = order.sorted_boxes(1, 8, (-1.0, -1.0, -1.0))
    return spark.createDataFrame([(i, *a) for i, (a, _) in enumerate(found)], "n int, x0 int, y0 int, z0 int")


@query("SELECT CAST(i AS INT) AS n, -5 + 10.0::DOUBLE / 8 * i AS lo, -5 + 10.0::DOUBLE / 8 * (i + 2) AS hi FROM (SELECT unnest(generate_series(0, 5)) AS i) t")
def index_boxes(spark, d):
    """Where index boxes of two cells lie in the cube that workers see."""
    rows = [(i, *(x[0] for x in order.index_box_bounds(3, (i, 0, 0), (i + 2, 1, 1)))) for i in range(6)]
    return spark.createDataFrame(rows, "n int, lo double, hi double")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    p = pts2(spark, d)
    return tree.with_ancestors(tree.occupied(p, cells.cube_of(p, 2), 4), 2)


@query("WITH r AS (SELECT unnest(generate_series(1, 4)) AS depth) SELECT CAST(depth AS INT) AS depth, depth < 4 AS deeper FROM r")
def walk_is_deeper_pts2(spark, d):
    """Whether a walk of so many levels from the root leaves blocks out: the tree has four."""
    blocks, out = _blocks(spark, d), None
    for depth in (1, 2, 3, 4):
        row = tree.is_deeper(blocks, (0, 0, 0), 2, depth).select(F.lit(depth).alias("depth"), "deeper")
        out = row if out is None else out.unionByName(row)
    return out


@query(with_views("pts2", "cube2", body="""+c AS (SELECT DISTINCT CAST(greatest(least(ceil((x - mx) / s * 16) - 1, 15), 0) AS INT) AS ix, CAST(greatest(least(ceil((y - my) / s * 16) - 1, 15), 0) AS INT) AS iy FROM pts2, cube2),
k AS (SELECT CAST(i AS INT) AS ix, CAST(j AS INT) AS iy FROM (SELECT unnest(generate_series(0, 15)) AS i) p, (SELECT unnest(generate_series(0, 15)) AS j) q)
SELECT 4 AS level, k.ix, k.iy, c.ix IS NOT NULL AS found FROM k LEFT JOIN c USING (ix, iy)"""))
def maybe_lookup_pts2(spark, d):
    """Every cell of a level, and whether the tree has it."""
    keys = mesh.odometer(spark, [16, 16], ["ix", "iy"]).select(F.lit(4).alias("level"), "ix", "iy")
    return tree.block_at(keys, _blocks(spark, d), 2, strict=False).select("level", "ix", "iy", "found")


@query(with_views("emb3", body="SELECT id, round((x + 5) / 10, 5) AS ex, round((y + 5) / 10, 5) AS ey FROM emb3"))
def worker_eyes_emb3(spark, d):
    p = emb3(spark, d)
    eye = order.worker_eye((p["x"], p["y"]))
    return p.select("id", F.round(eye[0], 5).alias("ex"), F.round(eye[1], 5).alias("ey"))


# -- views -------------------------------------------------------------------------------------------------

@query(with_views("rays", body="""+r AS (SELECT pixel, min(v) AS enter, max(v) AS leave FROM rays GROUP BY pixel), n AS (SELECT *, greatest(2, CAST(floor((leave - enter) / 50 * 0.5) AS INT) + 1) AS n FROM r)
SELECT pixel, CAST(step AS INT) AS step, round(enter + (leave - enter) * step / greatest(n - 1, 1), 4) AS t FROM n, (SELECT unnest(generate_series(0, 400)) AS step) s WHERE step < n"""))
def ray_samples_rays(spark, d):
    """Equal steps along each ray: as many as its length and the quality ask for."""
    r = rays(spark, d).groupBy("pixel").agg(F.min("v").alias("enter"), F.max("v").alias("leave"))
    return view.samples(r, view.sample_count(F.col("leave") - F.col("enter"), 50.0, 0.5)).select("pixel", "step", F.round("t", 4).alias("t"))


#: A transfer function over relative values, and the same as SQL of a relative value ``rel``.
RAMP = [(0.0, 0.0, 0.0, 1.0, 0.2), (0.5, 0.0, 1.0, 0.0, 0.6), (1.0, 1.0, 0.5, 0.0, 1.0)]
RAMP_SQL = {
    "r": "CASE WHEN rel <= 0.5 THEN 0 WHEN rel < 1 THEN (rel - 0.5) * 2 ELSE 1 END", "g": "CASE WHEN rel <= 0 THEN 0 WHEN rel < 0.5 THEN rel * 2 WHEN rel < 1 THEN 1 - (rel - 0.5) ELSE 0.5 END",
    "b": "CASE WHEN rel <= 0 THEN 1 WHEN rel < 0.5 THEN 1 - rel * 2 ELSE 0 END", "a": "CASE WHEN rel <= 0 THEN 0.2 WHEN rel < 0.5 THEN 0.2 + 0.8 * rel WHEN rel < 1 THEN 0.6 + 0.8 * (rel - 0.5) ELSE 1 END",
}


def composed(rows: str, order: str) -> str:
    """SQL that folds the rows' colours (pixel, r, g, b, a) front to back until opaque."""
    part = lambda c: f"CASE WHEN x.a + y.a * (1 - x.a) > 0 THEN x.{c} * x.a / (x.a + y.a * (1 - x.a)) + y.{c} * (y.a * (1 - x.a)) / (x.a + y.a * (1 - x.a)) ELSE x.{c} END"
    zero = "{'r': 0.0::DOUBLE, 'g': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'a': 0.0::DOUBLE}"
    colour = "{" + ", ".join(f"'{c}': CAST({c} AS DOUBLE)" for c in "rgba") + "}"
    step = "{" + ", ".join(f"'{c}': {part(c)}" for c in "rgb") + ", 'a': x.a + y.a * (1 - x.a)}"
    return f"fl AS (SELECT pixel, list({colour} ORDER BY {order}) AS l FROM ({rows}) t GROUP BY pixel), fd AS (SELECT pixel, list_reduce(list_prepend({zero}, l), lambda x, y: CASE WHEN x.a > 0.996 THEN x ELSE {step} END) AS c FROM fl)"


SHOWN = " SELECT pixel, round(c.r, 5) AS r, round(c.g, 5) AS g, round(c.b, 5) AS b, round(c.a, 5) AS a FROM fd"
REL = "rl AS (SELECT pixel, step, w, v / 500.0::DOUBLE AS rel FROM rays)"
RAMPED = f"rp AS (SELECT pixel, step, w, {', '.join(f'{e} AS {c}' for c, e in RAMP_SQL.items())} FROM rl)"


def shown(df: DataFrame) -> DataFrame:
    return df.select("pixel", *(F.round(c, 5).alias(c) for c in "rgba"))


@query(with_views("rays", body=f"+{REL}, {RAMPED}, " + composed("SELECT pixel, step, r, g, b, 1 - power(1 - 0.3 * a, 0.5) AS a FROM rp", "step") + SHOWN))
def argb_volume_rays(spark, d):
    """An opacity volume through a transfer function: opacity by the threshold's place in the range."""
    return shown(view.volume(rays(spark, d), ["pixel"], RAMP, 0.3, 0.0, 500.0, 0.5))


LIGHTS = [{"pos": (0.0, 0.0, 10.0), "ambient": (0.1, 0.1, 0.1), "diffuse": (0.8, 0.6, 0.4), "specular": (0.5, 0.5, 0.5)}, {"pos": (10.0, 0.0, 0.0), "ambient": (0.0, 0.0, 0.05), "diffuse": (0.2, 0.2, 0.2), "specular": (0.0, 0.0, 0.0)}]
# The normal (w - 3, 0, 2) at the origin, seen from (0, 0, 8): turned to the first light, then to the second.
NORMAL_SQL = """nn AS (SELECT *, (w - 3) / sqrt((w - 3) * (w - 3) + 4) AS nx, 2 / sqrt((w - 3) * (w - 3) + 4) AS nz FROM {rows}),
l1 AS (SELECT *, greatest(nz, 0) AS d1, CASE WHEN nz > 0 THEN power(greatest(nz, 0), 100) ELSE 0 END AS s1, CASE WHEN nx < 0 THEN -nx ELSE nx END AS mx, CASE WHEN nx < 0 THEN -nz ELSE nz END AS mz FROM nn),
lit AS (SELECT *, greatest(mx, 0) AS d2 FROM l1)"""
LIT_SQL = {c: f"greatest(0, least(1, {a1} + {d1} * {c} * d1 + 0.25 * s1 + {a2} + 0.2 * {c} * d2)) AS {c}" for c, a1, d1, a2 in (("r", 0.1, 0.8, 0.0), ("g", 0.1, 0.6, 0.0), ("b", 0.1, 0.4, 0.05))}


def shade(colour: list) -> list:
    length = F.sqrt((F.col("w") - 3) * (F.col("w") - 3) + 4)
    return colors.shaded([(F.col("w") - 3) / length, F.lit(0.0), 2 / length], [F.lit(0.0), F.lit(0.0), F.lit(8.0)], [F.lit(0.0)] * 3, colour, LIGHTS)


@query(with_views("rays", body=f"+{REL}, {RAMPED}, {NORMAL_SQL.format(rows='rp')}, " + composed(f"SELECT pixel, step, {', '.join(LIT_SQL.values())}, al AS a FROM (SELECT *, 1 - power(1 - 0.3 * a, 0.5) AS al FROM lit) q WHERE al >= 1e-5", "step") + SHOWN))
def argb_light_rays(spark, d):
    """The same, lit by two lights on both sides."""
    return shown(view.volume(rays(spark, d), ["pixel"], RAMP, 0.3, 0.0, 500.0, 0.5, shade))


CROSS = "ld AS (SELECT *, lead(v) OVER (PARTITION BY pixel ORDER BY step) AS v2, lead(w) OVER (PARTITION BY pixel ORDER BY step) AS w2 FROM rays)"


@query(with_views("rays", body=f"+{CROSS}, rl AS (SELECT pixel, step, (50 - v) / (v2 - v) AS t, w + (w2 - w) * (50 - v) / (v2 - v) AS w, 0.1::DOUBLE AS rel FROM ld WHERE (v - 50) * (v2 - 50) < 0), {RAMPED.replace('step, w', 'step, t, w')}, {NORMAL_SQL.format(rows='rp')}, " + composed(f"SELECT pixel, step, t, {', '.join(LIT_SQL.values())}, a * 0.5 AS a FROM lit", "step, t") + SHOWN))
def isosurface_image_rays(spark, d):
    """A half transparent, lit isosurface: the colour of its level, normals from a second field at the crossing."""
    found = view.crossings(rays(spark, d), 50.0, ["pixel"], value="w")
    return shown(view.surfaces(found, ["pixel"], RAMP, F.lit(50.0 / 500), 0.5, shade))


@query(with_views("rays", body=f"+{CROSS}, rl AS (SELECT pixel, step, (l - v) / (v2 - v) AS t, w, l / 500.0::DOUBLE AS rel FROM ld, (SELECT unnest([20.0::DOUBLE, 50.0::DOUBLE, 120.0::DOUBLE]) AS l) q WHERE (v - l) * (v2 - l) < 0), {RAMPED.replace('step, w', 'step, t, w')}, " + composed("SELECT pixel, step, t, r, g, b, a * 0.5 AS a FROM rp", "step, t") + SHOWN))
def isosurfaces_image_rays(spark, d):
    """Several isosurfaces, each in the colour of its level, in the order in which the ray meets them."""
    levels = [20.0, 50.0, 120.0]
    found = view.multi_crossings(rays(spark, d), levels, ["pixel"])
    at = F.element_at(F.array(*(F.lit(x / 500) for x in levels)), F.col("level_no") + 1)
    return shown(view.surfaces(found, ["pixel"], RAMP, at, 0.5))


@query(with_views("rays", body=f"+{CROSS}, rl AS (SELECT pixel, step, (50 - v) / (v2 - v) AS t, w, (w + (w2 - w) * (50 - v) / (v2 - v)) / 7 AS rel FROM ld WHERE (v - 50) * (v2 - 50) < 0), {RAMPED.replace('step, w', 'step, t, w')}, " + composed("SELECT pixel, step, t, r, g, b, a * 0.8 AS a FROM rp", "step, t") + SHOWN))
def value_image_rays(spark, d):
    """An isosurface in the colours of a second field."""
    found = view.crossings(rays(spark, d), 50.0, ["pixel"], value="w")
    return shown(view.surfaces(found, ["pixel"], RAMP, F.col("w") / 7, 0.8))


@query(with_views("rays", body=f"""+{REL}, {RAMPED}, """ + composed("SELECT pixel, step, r, g, b, 1 - power(1 - 0.3 * a, 0.5) AS a FROM rp WHERE step <= 2", "step") + """, px AS (SELECT pixel, 128 AS oa, pixel % 256 AS o_r, 64 AS og FROM (SELECT DISTINCT pixel FROM rays) t),
ab AS (SELECT pixel, c, oa / 255.0::DOUBLE * (1 - c.a) AS da, o_r / 255.0::DOUBLE AS o_r, og / 255.0::DOUBLE AS og FROM fd JOIN px USING (pixel)), mx AS (SELECT pixel, c.a + da AS a, (o_r * da + c.r * c.a) / (c.a + da) AS r, (og * da + c.g * c.a) / (c.a + da) AS g FROM ab)
SELECT pixel, CAST(floor(a * 255.999) AS INT) AS a, CAST(floor(r * 255.999) AS INT) AS r, CAST(floor(g * 255.999) AS INT) AS g FROM mx"""))
def drawn_pixels_rays(spark, d):
    """A volume's first samples above what the pixels show already, in packed colours."""
    r = rays(spark, d)
    pixels = r.select("pixel").distinct().withColumn("argb", F.lit(128 << 24).cast("long") + (F.col("pixel") % 256) * (1 << 16) + (64 << 8))
    image = view.volume(r.where("step <= 2"), ["pixel"], RAMP, 0.3, 0.0, 500.0, 0.5)
    red, green, _, alpha = colors.unpack(F.col("argb"))
    return view.drawn(image, pixels, ["pixel"]).select("pixel", alpha.alias("a"), red.alias("r"), green.alias("g"))


TABLE = [0.0, 1.0, 4.0, 9.0, 16.0]


@query(with_views("rays", body="""+p AS (SELECT pixel, step, greatest(0, least(1, v / 500.0::DOUBLE)) * 4 AS pos FROM rays), i AS (SELECT *, CAST(least(floor(pos), 3) AS INT) AS i FROM p)
SELECT pixel, step, round(i * i + ((i + 1) * (i + 1) - i * i) * (pos - i), 4) AS value FROM i"""))
def table_lookup_rays(spark, d):
    """A value through a table of five entries, between two of them by place."""
    table = F.array(*(F.lit(x) for x in TABLE))
    return rays(spark, d).select("pixel", "step", F.round(colors.table_lookup(table, F.col("v"), 0.0, 500.0, 5), 4).alias("value"))


@query(with_views("grid2", body="SELECT level, ix, iy, nx, ny, value FROM (SELECT 1 AS level, ix // 9 AS ix, iy // 9 AS iy, ix % 9 AS nx, iy % 9 AS ny, v AS value FROM grid2) t WHERE ix = 1"))
def view_query_grid2(spark, d):
    """What a view of one field, frame, level and index box reads of several."""
    g = grid2(spark, d).select(F.lit(1).alias("level"), F.floor(F.col("ix") / 9).cast("int").alias("bx"), F.floor(F.col("iy") / 9).cast("int").alias("b_y"), (F.col("ix") % 9).alias("nx"), (F.col("iy") % 9).alias("ny"), F.col("v").alias("value"))
    g = g.withColumnsRenamed({"bx": "ix", "b_y": "iy"})
    rows = None
    for name, frame, sign in (("p", 0, 1), ("p", 1, -1), ("q", 0, 0)):
        part = g.withColumn("value", F.col("value") * sign).withColumn("field", F.lit(name)).withColumn("frame", F.lit(frame))
        rows = part if rows is None else rows.unionByName(part)
    service = plan.FieldService(rows, [("p", 0.0, 1.0, True), ("q", 0.0, 1.0, False)], 2, 3, 2)
    q = plan.changed(plan.ViewQuery(primary="p", level=1, index_box=((1, 0), (2, 2))), frame=0)
    return service.of_query(q).select("level", "ix", "iy", "nx", "ny", "value")


@query(with_views("grid2", body="SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(25 AS INT) AS size, round(sum(v), 2) AS total FROM grid2 WHERE ix % 4 = 0 AND iy % 4 = 0"))
def dense_service_grid2(spark, d):
    """A subtree's whole lattice as the field service gives it."""
    g = grid2(spark, d).where("ix % 4 = 0 and iy % 4 = 0")
    rows = g.select(F.lit("p").alias("field"), F.lit(0).alias("frame"), F.lit(0).alias("level"), F.lit(0).alias("ix"), F.lit(0).alias("iy"), (F.col("ix") / 4).cast("int").alias("nx"), (F.col("iy") / 4).cast("int").alias("ny"), F.col("v").alias("value"))
    service = plan.FieldService(rows, [("p", 0.0, 1.0, False)], 1, 2, 2)
    whole = service.dense(plan.ViewQuery(primary="unknown", level=0))
    assert service.dense_size() == dense.dense_size(2, 2)
    return whole.agg(F.count("*").alias("nodes"), F.lit(service.dense_size()).alias("size"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT CAST(unnest(generate_series(0, 4)) AS INT) AS level, CAST(unnest([1, 4, 16, 64, 256]) AS BIGINT) AS blocks")
def exact_depth_tree(spark, d):
    """The full tree as deep as an analytic problem's cells ask for."""
    depth = tree.exact_depth(16.0, 1.0, 6)
    return tree.full_tree(spark, depth, 2).groupBy("level").agg(F.count("*").alias("blocks"))
