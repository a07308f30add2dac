"""Registered queries, one for each operator on a view of the test tables, with the same in SQL where SQL can say it.

Cells in SQL: ``cell(x, L)`` below is the clamped ceiling rule of the block tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octavo.functions import boxes, cells, colors, vectors
from octavo.functions.cells import Cube, cube_of
from octavo.operators import dense, fields, interpolate, mesh, order, telemetry, tree, view
from octavo.plans.adapters import emb3, frames, grid2, img2, pts2, pts3, rays, tele, with_views
from octavo.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from octavo.sources import readers
from octavo.storage import new_path
from octavo.streaming import stateful

def cell(x: str, m: str, level: int, s: str = "s") -> str:
    n = 1 << level
    return f"CAST(greatest(least(ceil(({x} - {m}) / {s} * {n}) - 1, {n - 1}), 0) AS INT)"


def r6(c) -> F.Column:
    return F.round(c, 6)


# -- tree -------------------------------------------------------------------------------------

L2 = 4
BLOCKS2 = f"""+cells2 AS (SELECT DISTINCT {cell('x', 'mx', L2)} AS ix, {cell('y', 'my', L2)} AS iy FROM pts2, cube2),
blocks2 AS (SELECT DISTINCT CAST(l AS INT) AS level, ix >> CAST({L2} - l AS INT) AS ix, iy >> CAST({L2} - l AS INT) AS iy FROM cells2, (SELECT unnest(generate_series(0, {L2})) AS l) t)"""
HEIGHTS2 = BLOCKS2 + """, heights2 AS (SELECT a.level, a.ix, a.iy, CAST(max(b.level) - a.level AS INT) AS height FROM blocks2 a JOIN blocks2 b
ON b.level >= a.level AND (b.ix >> (b.level - a.level)) = a.ix AND (b.iy >> (b.level - a.level)) = a.iy GROUP BY a.level, a.ix, a.iy)"""
SUBTREES2 = HEIGHTS2 + ", subtrees2 AS (SELECT level, ix, iy, least(height, 2) AS depth FROM heights2 WHERE level <= 0 OR height >= 2)"
NODES2 = SUBTREES2 + """, members2 AS (SELECT s.*, b.level AS bl, b.ix AS bx, b.iy AS b_y FROM subtrees2 s JOIN blocks2 b
ON b.level >= s.level AND b.level - s.level <= s.depth AND (b.ix >> (b.level - s.level)) = s.ix AND (b.iy >> (b.level - s.level)) = s.iy),
corners2 AS (SELECT *, depth - (bl - level) AS sh, c FROM members2, (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS c) t),
nodes2 AS (SELECT DISTINCT level, ix, iy, depth, ((bx << sh) & ((1 << depth) - 1)) + ((c & 1) << sh) AS nx, ((b_y << sh) & ((1 << depth) - 1)) + ((c >> 1) << sh) AS ny FROM corners2)"""


def _blocks2(spark: SparkSession, d: str) -> tuple[DataFrame, Cube, DataFrame]:
    p = pts2(spark, d)
    cube = cube_of(p, 2)
    return p, cube, tree.with_ancestors(tree.occupied(p, cube, L2), 2)


def _subtrees2(spark: SparkSession, d: str):
    p, cube, blocks = _blocks2(spark, d)
    return p, cube, blocks, tree.storage_subtrees(blocks, 2, 0, 2)


@query(with_views("pts2", body="SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM pts2"))
def bbox_pts2(spark, d):
    return cells.bounds(pts2(spark, d), 2)


@query(with_views("pts2", "cube2", body=f"SELECT 4 AS level, {cell('x', 'mx', 4)} AS ix, {cell('y', 'my', 4)} AS iy, count(*) AS points FROM pts2, cube2 GROUP BY 2, 3"))
def cube_cells_pts2(spark, d):
    p = pts2(spark, d)
    return tree.occupied(p, cube_of(p, 2), 4)


@query(with_views("pts3", "cube3", body=f"""+c AS (SELECT DISTINCT {cell('x', 'mx', 5)} AS ix, {cell('y', 'my', 5)} AS iy, {cell('z', 'mz', 5)} AS iz FROM pts3, cube3)
SELECT DISTINCT CAST(l AS INT) AS level, ix >> CAST(5 - l AS INT) AS ix, iy >> CAST(5 - l AS INT) AS iy, iz >> CAST(5 - l AS INT) AS iz FROM c, (SELECT unnest(generate_series(0, 5)) AS l) t"""))
def cells_with_ancestors_pts3(spark, d):
    p = pts3(spark, d)
    return tree.with_ancestors(tree.occupied(p, cube_of(p, 3), 5), 3)


@query(with_views("pts2", "cube2", body=BLOCKS2 + """, m AS (SELECT level - 1 AS level, ix >> 1 AS ix, iy >> 1 AS iy, bit_or(1 << (3 - ((ix & 1) + ((iy & 1) << 1)))) AS mask FROM blocks2 WHERE level > 0 GROUP BY 1, 2, 3)
SELECT b.level, b.ix, b.iy, coalesce(mask, 0) AS mask FROM blocks2 b LEFT JOIN m USING (level, ix, iy)"""))
def child_masks_pts2(spark, d):
    return tree.child_masks(_blocks2(spark, d)[2], 2)


@query(with_views("pts2", "cube2", body=BLOCKS2 + " SELECT level, ix, iy FROM blocks2"))
def compress_round_trip_pts2(spark, d):
    return tree.from_masks(tree.child_masks(_blocks2(spark, d)[2], 2), 2)


@query(with_views("pts2", "cube2", body=BLOCKS2 + """, k AS (SELECT a.level, a.ix, a.iy, count(b.level) AS n FROM blocks2 a LEFT JOIN blocks2 b ON b.level = a.level + 1 AND b.ix >> 1 = a.ix AND b.iy >> 1 = a.iy GROUP BY 1, 2, 3)
SELECT level, ix, iy, CAST(n AS INT) AS children, n = 4 AS has_all, n = 0 AS has_none, n > 0 AND n < 4 AS has_part FROM k"""))
def child_counts_pts2(spark, d):
    return tree.child_counts(_blocks2(spark, d)[2], 2)


@query(with_views("emb3", "cube3:emb3", body=f"""+c AS (SELECT id, {cell('x', 'mx', 3)} AS ix, {cell('y', 'my', 3)} AS iy, {cell('z', 'mz', 3)} AS iz FROM emb3, cube3),
k AS (SELECT ix, iy, iz FROM c GROUP BY ix, iy, iz HAVING count(*) >= 2), b AS (SELECT 3 AS level, ix, iy, iz FROM k UNION SELECT 2, ix >> 1, iy >> 1, iz >> 1 FROM k UNION SELECT 1, ix >> 2, iy >> 2, iz >> 2 FROM k UNION SELECT 0, 0, 0, 0),
f AS (SELECT c.id, max(b.level) AS level FROM c JOIN b ON (c.ix >> (3 - b.level)) = b.ix AND (c.iy >> (3 - b.level)) = b.iy AND (c.iz >> (3 - b.level)) = b.iz GROUP BY c.id)
SELECT id, level, c.ix >> (3 - level) AS ix, c.iy >> (3 - level) AS iy, c.iz >> (3 - level) AS iz FROM f JOIN c USING (id)"""))
def deepest_block_emb3(spark, d):
    """The tree of the cells with two vectors or more; all vectors are looked up in it."""
    p = emb3(spark, d)
    cube = cube_of(p, 3)
    blocks = tree.with_ancestors(tree.occupied(p, cube, 3).where("points > 1"), 3)
    return tree.deepest_block(p, blocks, cube, 3).select("id", "level", "ix", "iy", "iz")


@query(with_views("emb3", "cube3:emb3", body=f"""+c AS (SELECT id, {cell('x', 'mx', 3)} AS ix, {cell('y', 'my', 3)} AS iy, {cell('z', 'mz', 3)} AS iz FROM emb3, cube3),
k AS (SELECT ix, iy, iz FROM c GROUP BY ix, iy, iz HAVING count(*) >= 2), b AS (SELECT 2 AS level, ix >> 1 AS ix, iy >> 1 AS iy, iz >> 1 AS iz FROM k UNION SELECT 1, ix >> 2, iy >> 2, iz >> 2 FROM k UNION SELECT 0, 0, 0, 0)
SELECT c.id, max(b.level) AS level FROM c JOIN b ON (c.ix >> (3 - b.level)) = b.ix AND (c.iy >> (3 - b.level)) = b.iy AND (c.iz >> (3 - b.level)) = b.iz GROUP BY c.id"""))
def depth_limited_block_emb3(spark, d):
    p = emb3(spark, d)
    cube = cube_of(p, 3)
    blocks = tree.with_ancestors(tree.occupied(p, cube, 3).where("points > 1"), 3)
    return tree.deepest_block(p, blocks, cube, 2).select("id", "level")


@query(with_views("pts2", "cube2", body=HEIGHTS2 + " SELECT level, ix, iy, height FROM heights2"))
def block_heights_pts2(spark, d):
    return tree.heights(_blocks2(spark, d)[2], 2)


@query(with_views("pts2", "cube2", body=SUBTREES2 + " SELECT level, ix, iy, depth FROM subtrees2"))
def storage_subtrees_pts2(spark, d):
    return _subtrees2(spark, d)[3]


@query(with_views("pts2", "cube2", body=HEIGHTS2 + " SELECT level, ix, iy, least(height, 2) AS depth FROM heights2 WHERE level <= 1 OR height >= 2"))
def storage_subtrees_full1_pts2(spark, d):
    return tree.storage_subtrees(_blocks2(spark, d)[2], 2, 1, 2)


@query(with_views("pts2", "cube2", body=NODES2 + " SELECT level, ix, iy, depth, nx, ny FROM nodes2"))
def subtree_nodes_pts2(spark, d):
    _, _, blocks, subtrees = _subtrees2(spark, d)
    return tree.subtree_nodes(subtrees, blocks, 2)


@query(with_views("pts2", "cube2", body=NODES2 + " SELECT level, ix, iy, nx, ny, row_number() OVER (PARTITION BY level, ix, iy ORDER BY ny, nx) - 1 AS node FROM nodes2"))
def node_numbers_pts2(spark, d):
    _, _, blocks, subtrees = _subtrees2(spark, d)
    return tree.index_lookup(tree.subtree_nodes(subtrees, blocks, 2), 2).select("level", "ix", "iy", "nx", "ny", F.col("node").cast("long").alias("node"))


@query(with_views("pts2", "cube2", body=SUBTREES2 + """, f AS (SELECT b.level, b.ix, b.iy, max(s.level) AS s_level FROM blocks2 b JOIN subtrees2 s ON s.level <= b.level AND (b.ix >> (b.level - s.level)) = s.ix AND (b.iy >> (b.level - s.level)) = s.iy GROUP BY 1, 2, 3)
SELECT level, ix, iy, s_level, ix >> (level - s_level) AS s_ix, iy >> (level - s_level) AS s_iy FROM f"""))
def closest_subtree_pts2(spark, d):
    _, _, blocks, subtrees = _subtrees2(spark, d)
    return tree.closest_subtree(blocks, subtrees, 2)


def _morton2(x: str, y: str, bits: int) -> str:
    return "(" + " + ".join(f"((({x} >> {b}) & 1) << {2 * b}) + ((({y} >> {b}) & 1) << {2 * b + 1})" for b in range(bits)) + ")"


RANKED2 = BLOCKS2 + f""", n AS (SELECT *, row_number() OVER (ORDER BY level, {_morton2('ix', 'iy', L2)}) - 1 AS number FROM blocks2),
k AS (SELECT a.level, a.ix, a.iy, a.number, count(b.level) AS children FROM n a LEFT JOIN n b ON b.level = a.level + 1 AND b.ix >> 1 = a.ix AND b.iy >> 1 = a.iy GROUP BY 1, 2, 3, 4)"""


@query(with_views("pts2", "cube2", body=RANKED2 + """ SELECT level, ix, iy, number, CASE WHEN children > 0 THEN 1 + CAST(sum(children) OVER (ORDER BY number) - children AS BIGINT) END AS first_child FROM k"""))
def bfs_rank_pts2(spark, d):
    masks = tree.child_masks(_blocks2(spark, d)[2], 2)
    return tree.rank_index(masks, 2, L2).select("level", "ix", "iy", "number", "first_child")


@query("""SELECT CAST(l AS INT) AS level, CAST(x AS INT) AS ix, CAST(y AS INT) AS iy FROM (SELECT unnest(generate_series(0, 3)) AS l) a, (SELECT unnest(generate_series(0, 7)) AS x) b, (SELECT unnest(generate_series(0, 7)) AS y) c WHERE x < (1 << l) AND y < (1 << l)""")
def full_tree_level3(spark, d):
    return tree.full_tree(spark, 3, 2)


@query(with_views("pts2", "cube2", body=BLOCKS2 + """ SELECT level, ix, iy FROM blocks2 UNION SELECT CAST(l AS INT), CAST(x AS INT), CAST(y AS INT) FROM (SELECT unnest(generate_series(0, 3)) AS l) a, (SELECT unnest(generate_series(0, 7)) AS x) b, (SELECT unnest(generate_series(0, 7)) AS y) c WHERE x < (1 << l) AND y < (1 << l)"""))
def full_tree_union_pts2(spark, d):
    return tree.filled(_blocks2(spark, d)[2], 3, 2)


@query(with_views("pts2", "cube2", body=NODES2 + f""", c AS (SELECT level, ix, iy, depth, count(*) AS node_count FROM nodes2 GROUP BY 1, 2, 3, 4),
o AS (SELECT *, {_morton2('ix', 'iy', L2)} << ((4 - level) * 2) AS path FROM c)
SELECT level, ix, iy, depth, node_count, CAST(coalesce(sum((node_count + 2) * 4) OVER (ORDER BY path, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS values_pos,
round(node_count / power((1 << depth) + 1, 2), 6) AS fill FROM o"""))
def metadata_info_pts2(spark, d):
    _, _, blocks, subtrees = _subtrees2(spark, d)
    return tree.metadata(subtrees, blocks, 2, L2)


@query(with_views("pts2", "cube2", body=BLOCKS2 + """, c AS (SELECT level, c, (ix + (c & 1)) << (4 - level) AS nx, (iy + (c >> 1)) << (4 - level) AS ny FROM blocks2, (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS c) t),
s AS (SELECT nx, ny, c, max(level) AS level FROM c GROUP BY 1, 2, 3)
SELECT nx, ny, max(level) AS deepest, arg_max(c, (level, -c)) AS slot FROM s GROUP BY 1, 2"""))
def deepest_neighbour_pts2(spark, d):
    return tree.deepest_neighbour(_blocks2(spark, d)[2], 2, L2)


@query(with_views("pts2", "cube2", body=BLOCKS2 + " SELECT level, ix, iy FROM blocks2 WHERE level BETWEEN 1 AND 3 AND ix >> (level - 1) = 1 AND iy >> (level - 1) = 0"))
def depth_limited_walk_pts2(spark, d):
    return tree.walk(_blocks2(spark, d)[2], (1, 1, 0), 2, 2)


@query(with_views("pts2", "cube2", body=SUBTREES2 + " SELECT level, count(*) AS blocks, max(depth) AS depth FROM subtrees2 GROUP BY level"))
def subtree_levels_pts2(spark, d):
    return tree.levels(_subtrees2(spark, d)[3])


@query(with_views("pts2", "cube2", body=BLOCKS2 + " SELECT level, ix, iy FROM blocks2 WHERE level = 3"))
def block_lookup_pts2(spark, d):
    """Exact lookup of the blocks of one level."""
    blocks = _blocks2(spark, d)[2]
    return tree.block_at(blocks.where("level = 3"), blocks, 2)


@query(with_views("pts3", "cube3", body="""+g AS (SELECT x, y, z, v, CAST(least(floor(ln(s / (1 + v / 20000)) / ln(2.0) + 0.5), 4) AS INT) AS lv, s, mx, my, mz FROM pts3, cube3),
c AS (SELECT DISTINCT lv, CAST(greatest(least(ceil((x - mx) / s * (1 << lv)) - 1, (1 << lv) - 1), 0) AS INT) AS ix, CAST(greatest(least(ceil((y - my) / s * (1 << lv)) - 1, (1 << lv) - 1), 0) AS INT) AS iy, CAST(greatest(least(ceil((z - mz) / s * (1 << lv)) - 1, (1 << lv) - 1), 0) AS INT) AS iz FROM g)
SELECT DISTINCT CAST(l AS INT) AS level, ix >> CAST(lv - l AS INT) AS ix, iy >> CAST(lv - l AS INT) AS iy, iz >> CAST(lv - l AS INT) AS iz FROM c, (SELECT unnest(generate_series(0, 4)) AS l) t WHERE l <= lv"""))
def sized_blocks_pts3(spark, d):
    """Blocks at the level that suits each point's size."""
    p = pts3(spark, d).withColumn("size", 1 + F.col("v") / 20000)
    return tree.from_levels(p, cube_of(p, 3), 4, "size")


# -- mesh -------------------------------------------------------------------------------------


def _elements(spark: SparkSession) -> DataFrame:
    return mesh.structured_elements(spark, [17, 17])


@query(with_views("elem2", body="SELECT zone_id, element_id, n0, n1, n2, n3 FROM elem2"))
def grid_elements_grid2(spark, d):
    return _elements(spark).select("zone_id", "element_id", *(F.get("nodes", F.lit(i)).alias(f"n{i}") for i in range(4)))


@query(with_views("grid2", "elem2", body="SELECT zone_id, element_id, CAST(n0 % 17 AS DOUBLE) AS min_x, CAST(n1 % 17 AS DOUBLE) AS max_x, CAST(n0 // 17 AS DOUBLE) AS min_y, CAST(n3 // 17 AS DOUBLE) AS max_y, 1.0 AS size FROM elem2"))
def element_boxes_grid2(spark, d):
    return mesh.element_boxes(_elements(spark), grid2(spark, d), 2)


BOUNDARY = """+e AS (SELECT element_id, 0 AS face, n3 AS a, n0 AS b FROM elem2 UNION ALL SELECT element_id, 1, n1, n2 FROM elem2 UNION ALL SELECT element_id, 2, n0, n1 FROM elem2 UNION ALL SELECT element_id, 3, n2, n3 FROM elem2),
bf AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.a = e.b AND o.b = e.a))"""


@query(with_views("elem2", body=BOUNDARY + " SELECT 0 AS zone_id, element_id, face, a, b FROM bf"))
def boundary_faces_grid2(spark, d):
    return mesh.boundary_faces(_elements(spark)).select("zone_id", "element_id", "face", F.get("nodes", F.lit(0)).alias("a"), F.get("nodes", F.lit(1)).alias("b"))


@query(with_views("elem2", body=BOUNDARY + " SELECT 0 AS zone_id, node_id, row_number() OVER (ORDER BY node_id) - 1 AS number FROM (SELECT a AS node_id FROM bf UNION SELECT b FROM bf) t"))
def boundary_nodes_grid2(spark, d):
    return mesh.boundary_nodes(mesh.boundary_faces(_elements(spark)))


@query(with_views("elem2", body=BOUNDARY + " SELECT DISTINCT 0 AS zone_id, element_id FROM bf"))
def boundary_elements_grid2(spark, d):
    e = _elements(spark)
    return mesh.boundary_elements(e, mesh.boundary_faces(e)).select("zone_id", "element_id")


@query("SELECT 6 * 8 * 8 AS faces, 9 * 9 * 9 - 7 * 7 * 7 AS nodes")
def boundary_of_cube(spark, d):
    """A cube of 8 x 8 x 8 hexahedra: 6 n^2 boundary faces."""
    f = mesh.boundary_faces(mesh.structured_elements(spark, [9, 9, 9]))
    return f.agg(F.count("*").alias("faces")).join(mesh.boundary_nodes(f).agg(F.count("*").alias("nodes"))).select(F.col("faces").cast("int"), F.col("nodes").cast("int"))


@query(with_views("elem2", body="SELECT zone_id, element_id, 0 AS simplex, n0 AS a, n1 AS b, n2 AS c FROM elem2 UNION ALL SELECT zone_id, element_id, 1, n0, n2, n3 FROM elem2"))
def simplex_split_grid2(spark, d):
    return mesh.simplices(_elements(spark)).select("zone_id", "element_id", "simplex", *(F.get("nodes", F.lit(i)).alias(n) for i, n in enumerate("abc")))


@query(with_views("pts3", body="SELECT zone, CASE WHEN grouping(zone) = 0 THEN 'point' END AS etype, count(*) AS elements, count(DISTINCT x * 1000000 + y * 1000 + z) AS nodes FROM pts3 GROUP BY zone UNION ALL SELECT NULL, NULL, count(*), sum(k) FROM (SELECT zone, count(DISTINCT x * 1000000 + y * 1000 + z) AS k FROM pts3 GROUP BY zone) a, (SELECT 1) b").replace("UNION ALL SELECT NULL, NULL, count(*), sum(k) FROM (SELECT zone, count(DISTINCT x * 1000000 + y * 1000 + z) AS k FROM pts3 GROUP BY zone) a, (SELECT 1) b", "UNION ALL SELECT NULL, NULL, sum(n), sum(k) FROM (SELECT zone, count(*) AS n, count(DISTINCT x * 1000000 + y * 1000 + z) AS k FROM pts3 GROUP BY zone) a"))
def mesh_info_pts3(spark, d):
    zones = pts3(spark, d).groupBy("zone").agg(F.lit("point").alias("etype"), F.count("*").alias("elements"), F.count_distinct(F.col("x") * 1000000 + F.col("y") * 1000 + F.col("z")).alias("nodes"))
    return mesh.mesh_info(zones)


@query(with_views("pts3", body="SELECT zone AS zone_id, count(*) AS nodes FROM pts3 GROUP BY zone"))
def zone_counts_pts3(spark, d):
    return readers.zone_counts(pts3(spark, d).withColumnRenamed("zone", "zone_id"))


@query(with_views("elem2", body="SELECT zone_id, element_id, CAST(i AS INT) AS i_x, CAST(j AS INT) AS i_y, n0 % 17 + i / 2.0 AS x, n0 // 17 + j / 2.0 AS y FROM elem2, (SELECT unnest(generate_series(0, 2)) AS i) a, (SELECT unnest(generate_series(0, 2)) AS j) b WHERE element_id < 0 OR true").replace("i / 2.0", "CAST(i AS DOUBLE)").replace("j / 2.0", "CAST(j AS DOUBLE)").replace("generate_series(0, 2)", "generate_series(0, 1)").replace(" WHERE element_id < 0 OR true", ""))
def refined_elements_grid2(spark, d):
    """Lattice of the refined elements: one step for each unit edge."""
    e = _elements(spark)
    r = mesh.refined(e, grid2(spark, d), 2, 1.0)
    return r.select("zone_id", "element_id", "i_x", "i_y", "x", "y")


# -- fields -----------------------------------------------------------------------------------

CORNER2 = """+p AS (SELECT *, CAST(greatest(least(ceil((x - mx) / s * 16) - 1, 15), 0) AS INT) AS ix, CAST(greatest(least(ceil((y - my) / s * 16) - 1, 15), 0) AS INT) AS iy FROM pts2, cube2),
t AS (SELECT *, (x - (mx + ix * (s / 16))) / (s / 16) AS tx, (y - (my + iy * (s / 16))) / (s / 16) AS ty FROM p),
w AS (SELECT ix + (c & 1) AS nx, iy + (c >> 1) AS ny, v, greatest((CASE WHEN c & 1 = 1 THEN tx ELSE 1 - tx END) * (CASE WHEN c >> 1 = 1 THEN ty ELSE 1 - ty END), 2e-5) AS w FROM t, (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS c) q),
f AS (SELECT nx, ny, CASE WHEN sum(w) >= 1e-5 THEN sum(v * w) / sum(w) END AS value FROM w GROUP BY nx, ny)"""


@query(with_views("pts2", "cube2", body=CORNER2 + " SELECT nx, ny, round(value, 6) AS value FROM f"))
def corner_weighted_mean_pts2(spark, d):
    p = pts2(spark, d)
    f = fields.corner_mean(p, cube_of(p, 2), 4, "v")
    return f.select("nx", "ny", r6(F.col("value")).alias("value"))


@query(with_views("pts2", "cube2", body=CORNER2.replace("(CASE WHEN c & 1 = 1 THEN tx ELSE 1 - tx END) * (CASE WHEN c >> 1 = 1 THEN ty ELSE 1 - ty END)", "(CASE WHEN c & 1 = 1 THEN ty ELSE 1 - ty END) * (CASE WHEN c >> 1 = 1 THEN tx ELSE 1 - tx END)") + " SELECT nx, ny, round(value, 6) AS value FROM f"))
def corner_weighted_mean_compat_pts2(spark, d):
    """With the axes of the weights reversed."""
    p = pts2(spark, d)
    return fields.corner_mean(p, cube_of(p, 2), 4, "v", compat_axis_order=True).select("nx", "ny", r6(F.col("value")).alias("value"))


CORNER3 = f"""+p AS (SELECT *, {cell('x', 'mx', 3)} AS ix, {cell('y', 'my', 3)} AS iy, {cell('z', 'mz', 3)} AS iz FROM pts3, cube3),
t AS (SELECT *, (x - (mx + ix * (s / 8))) / (s / 8) AS tx, (y - (my + iy * (s / 8))) / (s / 8) AS ty, (z - (mz + iz * (s / 8))) / (s / 8) AS tz FROM p),
w AS (SELECT ix + (c & 1) AS nx, iy + ((c >> 1) & 1) AS ny, iz + (c >> 2) AS nz, v, greatest((CASE WHEN c & 1 = 1 THEN tx ELSE 1 - tx END) * (CASE WHEN (c >> 1) & 1 = 1 THEN ty ELSE 1 - ty END) * (CASE WHEN c >> 2 = 1 THEN tz ELSE 1 - tz END), 2e-5) AS w FROM t, (SELECT CAST(unnest(generate_series(0, 7)) AS INT) AS c) q)"""


@query(with_views("pts3", "cube3", body=CORNER3 + " SELECT nx, ny, nz, round(CASE WHEN sum(w) >= 1e-5 THEN sum(v * w) / sum(w) END, 4) AS value FROM w GROUP BY nx, ny, nz"))
def corner_weighted_mean_pts3(spark, d):
    p = pts3(spark, d)
    return fields.corner_mean(p, cube_of(p, 3), 3, "v").select("nx", "ny", "nz", F.round("value", 4).alias("value"))


@query(with_views("img2", body="""+w AS (SELECT ix + (c & 1) AS nx, iy + (c >> 1) AS ny, v, 0.25 AS w FROM img2, (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS c) q WHERE n % 2 = 0)
SELECT nx, ny, round(sum(v * w) / sum(w), 6) AS value FROM w GROUP BY nx, ny"""))
def image_field_img2(spark, d):
    """Voxel centres of the domain (even counts) on the image's own lattice."""
    p = fields.image_points(fields.stencil(img2(spark, d), F.col("n") % 2 == 0), 2)
    return fields.corner_mean(p.select("x", "y", "v"), Cube((0.0, 0.0), 16.0), 4, "v").select("nx", "ny", r6(F.col("value")).alias("value"))


@query(with_views("img2", body="SELECT ix, iy FROM img2 WHERE (ix - 8) * (ix - 8) + (iy - 8) * (iy - 8) <= 36"))
def sphere_mask_img2(spark, d):
    return fields.stencil(img2(spark, d), fields.sphere_mask(2, (8, 8), 6)).select("ix", "iy")


@query(with_views("img2", body="""SELECT DISTINCT CAST(l AS INT) AS level, ix >> CAST(4 - l AS INT) AS ix, iy >> CAST(4 - l AS INT) AS iy FROM img2, (SELECT unnest(generate_series(0, 3)) AS l) t WHERE n % 2 = 0"""))
def image_tree_img2(spark, d):
    """Blocks of the domain's voxels, down to one level above single voxels."""
    at = cells.image_block([F.col("ix"), F.col("iy")], 4, 3)
    c = fields.stencil(img2(spark, d), F.col("n") % 2 == 0).select(F.lit(3).alias("level"), at[0].alias("ix"), at[1].alias("iy"))
    return tree.with_ancestors(c, 2)


@query(with_views("pts2", "cube2", body=BLOCKS2 + """, c AS (SELECT level, (ix + (c & 1)) << (4 - level) AS nx, (iy + (c >> 1)) << (4 - level) AS ny FROM blocks2, (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS c) t)
SELECT nx, ny, round(avg(nx / 16.0 * 2 - ny / 16.0), 6) AS value FROM c GROUP BY nx, ny"""))
def func_field_pts2(spark, d):
    """A linear function at block corners, meaned over the blocks that touch them."""
    blocks = _blocks2(spark, d)[2].withColumn("c", F.explode(cells.corner_bits(2)))
    node = [cells.left(F.col(i) + cells.bit(F.col("c"), k), F.lit(L2) - F.col("level")) for k, i in enumerate(("ix", "iy"))]
    corners = blocks.select(node[0].alias("nx"), node[1].alias("ny")).select("nx", "ny", (F.col("nx") / 16).alias("x"), (F.col("ny") / 16).alias("y"))
    return fields.function_field(corners, F.col("x") * 2 - F.col("y")).select("nx", "ny", r6(F.col("value")).alias("value"))


@query(with_views("pts2", "cube2", body=CORNER2 + " SELECT nx >> 2 AS bx, ny >> 2 AS b_y, coalesce(round(min(value), 6), 0) AS min, coalesce(round(max(value), 6), -1) AS max FROM f GROUP BY 1, 2"))
def field_range_per_subtree_pts2(spark, d):
    p = pts2(spark, d)
    f = fields.corner_mean(p, cube_of(p, 2), 4, "v").select(cells.right(F.col("nx"), 2).alias("bx"), cells.right(F.col("ny"), 2).alias("b_y"), "value")
    return fields.field_range(f, ["bx", "b_y"]).select("bx", "b_y", r6(F.col("min")).alias("min"), r6(F.col("max")).alias("max"))


@query(with_views("frames", body="SELECT field, min(value) AS min, max(value) AS max FROM frames GROUP BY field"))
def field_range_global_frames(spark, d):
    """Ranges of each frame first, then over all frames; an inverted range from an empty frame is ignored."""
    each = fields.field_range(frames(spark, d), ["field", "frame"])
    empty = each.select("field", F.lit(-1).cast("long").alias("frame"), F.lit(0.0).alias("min"), F.lit(-1.0).alias("max")).distinct()
    return fields.merged_range(each.unionByName(empty), ["field"])


@query(with_views("frames", body="SELECT field, frame FROM (SELECT DISTINCT field, frame FROM frames) t WHERE frame % 2 = 1"))
def missing_fields_frames(spark, d):
    """(field, frame) pairs without a file yet; the even frames have one."""
    wanted = frames(spark, d).select("field", "frame").distinct()
    return fields.missing_fields(wanted, wanted.where("frame % 2 = 0"))


def _level_field(spark: SparkSession, d: str):
    """The 17 x 17 lattice as four level-1 subtrees of depth 3 under a root of depth 3."""
    g = grid2(spark, d)
    parts = None
    for ox in (0, 1):
        for oy in (0, 1):
            part = g.where(F.col("ix").between(8 * ox, 8 * ox + 8) & F.col("iy").between(8 * oy, 8 * oy + 8)).select(F.lit(1).alias("level"), F.lit(ox).alias("ix"), F.lit(oy).alias("iy"), F.lit(3).alias("depth"), (F.col("ix") - 8 * ox).alias("nx"), (F.col("iy") - 8 * oy).alias("ny"), F.col("v").alias("value"))
            parts = part if parts is None else parts.unionByName(part)
    roots = spark.createDataFrame([(0, 0, 0, 3), *[(1, x, y, 3) for x in (0, 1) for y in (0, 1)]], "level int, ix int, iy int, depth int")
    return parts, roots


@query(with_views("grid2", body="SELECT ix // 2 AS nx, iy // 2 AS ny, round(v, 6) AS value FROM grid2 WHERE ix % 2 = 0 AND iy % 2 = 0"))
def propagate_levels_grid2(spark, d):
    """Four child subtrees rolled up into the root: every second lattice node."""
    own, roots = _level_field(spark, d)
    return fields.propagate(own, roots, 2, 1).where("level = 0").select("nx", "ny", r6(F.col("value")).alias("value"))


@query(with_views("grid2", body="""+k AS (SELECT (1 * 2 + CASE WHEN ox = 1 THEN 1 ELSE 0 END) AS q, ox, oy, (ix - 8 * ox) // 2 + (ox << 2) AS nx, (iy - 8 * oy) // 2 + (oy << 2) AS ny, v FROM grid2, (SELECT unnest(generate_series(0, 1)) AS ox) a, (SELECT unnest(generate_series(0, 1)) AS oy) b WHERE ix BETWEEN 8 * ox AND 8 * ox + 8 AND iy BETWEEN 8 * oy AND 8 * oy + 8 AND ix % 2 = 0 AND iy % 2 = 0 AND NOT (ox = 1 AND oy = 1)),
m AS (SELECT nx, ny, avg(v) AS c FROM k GROUP BY 1, 2)
SELECT CAST(coalesce(m.nx, o.x) AS INT) AS nx, CAST(coalesce(m.ny, o.y) AS INT) AS ny, round(coalesce(c, 1.0), 6) AS value FROM m FULL JOIN (SELECT unnest(generate_series(0, 8)) AS x, y FROM (SELECT unnest(generate_series(0, 8)) AS y) z) o ON m.nx = o.x AND m.ny = o.y"""))
def propagate_mixed_grid2(spark, d):
    """Three of four children: the parent keeps its own values (1.0) where no child has a node."""
    own, roots = _level_field(spark, d)
    root_own = dense.lattice(spark, 3, 2).select(F.lit(0).alias("level"), F.lit(0).alias("ix"), F.lit(0).alias("iy"), F.lit(3).alias("depth"), "nx", "ny", F.lit(1.0).alias("value"))
    kept = own.where("not (ix = 1 and iy = 1)").unionByName(root_own)
    return fields.propagate(kept, roots, 2, 1).where("level = 0").select("nx", "ny", r6(F.col("value")).alias("value"))


def _half(spark: SparkSession, d: str):
    """The lattice's elements mapped onto the nodes of a lattice twice as fine."""
    nodes = grid2(spark, d)
    return _elements(spark), nodes, Cube((0.0, 0.0), 16.0)


HALF = """+k AS (SELECT element_id, n0, CAST(a AS INT) AS a, CAST(b AS INT) AS b, 2 * (n0 % 17) + a AS nx, 2 * (n0 // 17) + b AS ny FROM elem2, (SELECT unnest(generate_series(0, 2)) AS a) p, (SELECT unnest(generate_series(0, 2)) AS b) q),
v AS (SELECT k.element_id, nx, ny, g0.v * (2 - a) * (2 - b) / 4.0 + g1.v * a * (2 - b) / 4.0 + g2.v * a * b / 4.0 + g3.v * (2 - a) * b / 4.0 AS value FROM k JOIN grid2 g0 ON g0.node_id = n0 JOIN grid2 g1 ON g1.node_id = n0 + 1 JOIN grid2 g2 ON g2.node_id = n0 + 18 JOIN grid2 g3 ON g3.node_id = n0 + 17)"""


@query(with_views("elem2", "grid2", body=HALF + " SELECT CAST(nx AS INT) AS nx, CAST(ny AS INT) AS ny, round(arg_min(value, element_id), 4) AS value FROM v GROUP BY nx, ny"))
def interp_first_wins_grid2(spark, d):
    e, nodes, cube = _half(spark, d)
    return interpolate.apply_map(interpolate.cube_map(e, nodes, cube, 5), nodes, "v", 2, first_wins=True).select("nx", "ny", F.round("value", 4).alias("value"))


@query(with_views("elem2", "grid2", body=HALF + " SELECT CAST(nx AS INT) AS nx, CAST(ny AS INT) AS ny, round(arg_max(value, element_id), 4) AS value FROM v GROUP BY nx, ny"))
def interp_last_wins_grid2(spark, d):
    e, nodes, cube = _half(spark, d)
    return interpolate.apply_map(interpolate.cube_map(e, nodes, cube, 5), nodes, "v", 2).select("nx", "ny", F.round("value", 4).alias("value"))


@query(with_views("grid2", body="SELECT ix AS nx, iy AS ny, round(v, 4) AS value FROM grid2"))
def simplex_map_grid2(spark, d):
    """Triangles mapped onto the lattice's own nodes give the nodes' values back."""
    e, nodes, cube = _half(spark, d)
    return interpolate.apply_map(interpolate.simplex_map(e, nodes, cube, 4), nodes, "v", 2).select("nx", "ny", F.round("value", 4).alias("value"))


@query("SELECT CAST(0 AS BIGINT) AS bad, CAST(2304 AS BIGINT) AS mapped")
def bad_elements_grid2(spark, d):
    e, nodes, cube = _half(spark, d)
    return interpolate.bad_elements(interpolate.cube_map(e, nodes, cube, 5))


# -- dense ------------------------------------------------------------------------------------


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    """Every lattice node with even coordinates, but one."""
    g = grid2(spark, d)
    return g.where("ix % 2 = 0 and iy % 2 = 0 and not (ix = 4 and iy = 4)").select(F.col("ix").alias("nx"), F.col("iy").alias("ny"), F.col("v").alias("value"))


LATTICE = """+l AS (SELECT CAST(x AS INT) AS nx, CAST(y AS INT) AS ny FROM (SELECT unnest(generate_series(0, 16)) AS x) a, (SELECT unnest(generate_series(0, 16)) AS y) b),
s0 AS (SELECT l.nx, l.ny, CASE WHEN nx % 2 = 0 AND ny % 2 = 0 AND NOT (nx = 4 AND ny = 4) THEN v END AS value FROM l JOIN grid2 ON ix = nx AND iy = ny)"""


@query(with_views("grid2", body=LATTICE + " SELECT nx, ny, round(value, 6) AS value FROM s0"))
def dense_scatter_grid2(spark, d):
    return dense.scatter(_sparse(spark, d), 4, 2).select("nx", "ny", r6(F.col("value")).alias("value"))


def _fill_sql(steps: list[int]) -> str:
    """Midpoint fill in SQL: for each half step, first edges, then faces."""
    out, last = LATTICE, "s0"
    for i, h in enumerate(steps):
        edge = f"(a.nx % {2 * h} = {h} AND a.ny % {2 * h} = 0 AND b.ny = a.ny AND abs(b.nx - a.nx) = {h}) OR (a.ny % {2 * h} = {h} AND a.nx % {2 * h} = 0 AND b.nx = a.nx AND abs(b.ny - a.ny) = {h})"
        face = f"a.nx % {2 * h} = {h} AND a.ny % {2 * h} = {h} AND abs(b.nx - a.nx) + abs(b.ny - a.ny) = {h} AND (b.nx = a.nx OR b.ny = a.ny)"
        for name, on, n in ((f"e{i}", edge, 2), (f"f{i}", face, 4)):
            out += f", {name} AS (SELECT l.nx, l.ny, coalesce(l.value, m.value) AS value FROM {last} l LEFT JOIN (SELECT a.nx, a.ny, CASE WHEN count(b.value) = {n} THEN avg(b.value) END AS value FROM {last} a JOIN {last} b ON {on} GROUP BY 1, 2) m USING (nx, ny))"
            last = name
    return out + f" SELECT nx, ny, round(value, 4) AS value FROM {last}"


@query(with_views("grid2", body=_fill_sql([1])))
def dense_fill_level1_grid2(spark, d):
    """The finest level's midpoints by DataFrame joins: edges, then faces."""
    return dense.fill_level(dense.scatter(_sparse(spark, d), 4, 2), 3, 4, 2).select("nx", "ny", F.round("value", 4).alias("value"))


@query(with_views("grid2", body=_fill_sql([8, 4, 2, 1])))
def dense_fill_grid2(spark, d):
    s = _sparse(spark, d).withColumn("field", F.lit("v"))
    return dense.fill(s, ["field"], 2, 4).select("nx", "ny", F.round("value", 4).alias("value"))


@query(with_views("grid2", body="SELECT ix AS nx, iy AS ny, round((v - 10000) / 50000.0, 6) AS value FROM grid2"))
def dense_normalized_grid2(spark, d):
    g = grid2(spark, d).select(F.col("ix").alias("nx"), F.col("iy").alias("ny"), F.col("v").alias("value"))
    return dense.normalized(g, 10000.0, 60000.0).select("nx", "ny", r6(F.col("value")).alias("value"))


# -- view -------------------------------------------------------------------------------------


@query(with_views("rays", body="SELECT pixel, round((max(CASE WHEN v >= 100 THEN v END) - 0.0) / 500.0, 6) AS t FROM rays GROUP BY pixel"))
def mip_rays(spark, d):
    return view.max_intensity(rays(spark, d), 100.0, 0.0, 500.0, ["pixel"]).select("pixel", r6(F.col("t")).alias("t"))


LEADS = "+n AS (SELECT *, lead(v) OVER (PARTITION BY pixel ORDER BY step) AS v2, lead(w) OVER (PARTITION BY pixel ORDER BY step) AS w2 FROM rays)"


@query(with_views("rays", body=LEADS + " SELECT pixel, CAST(step AS INT) AS step, round((50 - v) / (v2 - v), 6) AS t FROM n WHERE (v - 50) * (v2 - 50) < 0"))
def iso_crossings_rays(spark, d):
    return view.crossings(rays(spark, d), 50.0, ["pixel"]).select("pixel", "step", r6(F.col("t")).alias("t"))


@query(with_views("rays", body=LEADS + " SELECT pixel, CAST(step AS INT) AS step, round((50 - v) / (v2 - v), 6) AS t, round(w + (w2 - w) * ((50 - v) / (v2 - v)), 6) AS w FROM n WHERE (v - 50) * (v2 - 50) < 0"))
def value_on_isosurface_rays(spark, d):
    return view.crossings(rays(spark, d), 50.0, ["pixel"], value="w").select("pixel", "step", r6(F.col("t")).alias("t"), r6(F.col("w")).alias("w"))


@query(with_views("rays", body=LEADS + " SELECT pixel, CAST(step AS INT) AS step, CAST(i AS INT) AS level_no, round((l - v) / (v2 - v), 6) AS t FROM n, (SELECT 0 AS i, 20.0 AS l UNION ALL SELECT 1, 50.0 UNION ALL SELECT 2, 120.0) q WHERE (v - l) * (v2 - l) < 0"))
def iso_multi_crossings_rays(spark, d):
    return view.multi_crossings(rays(spark, d), [50.0, 120.0, 20.0, 50.0], ["pixel"]).select("pixel", "step", "level_no", r6(F.col("t")).alias("t"))


@query(with_views("rays", body=LEADS + " SELECT pixel, CAST(step AS INT) AS step, CAST(i AS INT) AS level_no, round((l - v) / (v2 - v), 6) AS t, round(w + (w2 - w) * ((l - v) / (v2 - v)), 6) AS w FROM n, (SELECT 0 AS i, 20.0 AS l UNION ALL SELECT 1, 50.0 UNION ALL SELECT 2, 120.0) q WHERE (v - l) * (v2 - l) < 0"))
def value_on_isosurfaces_rays(spark, d):
    return view.multi_crossings(rays(spark, d), [20.0, 50.0, 120.0], ["pixel"], value="w").select("pixel", "step", "level_no", r6(F.col("t")).alias("t"), r6(F.col("w")).alias("w"))


@query(with_views("rays", body=LEADS + " SELECT pixel, CAST(min(step) AS INT) AS step FROM n WHERE (v - 50) * (v2 - 50) < 0 GROUP BY pixel"))
def nearest_isosurface_rays(spark, d):
    return view.nearest_crossing(view.crossings(rays(spark, d), 50.0, ["pixel"]), ["pixel"]).select("pixel", "step")


FOLD = """+s AS (SELECT pixel, step, least(greatest(v / 500.0, 0), 1) AS rel FROM rays),
g AS (SELECT pixel, list({'c': rel, 'a': 1 - power(1 - 0.2 * rel, 0.5)} ORDER BY step) AS l FROM s GROUP BY pixel),
f AS (SELECT pixel, list_reduce(list_prepend({'c': 0.0::DOUBLE, 'a': 0.0::DOUBLE}, l), lambda x, y: CASE WHEN x.a > 0.996 THEN x ELSE {'c': CASE WHEN x.a + y.a * (1 - x.a) > 0 THEN x.c * x.a / (x.a + y.a * (1 - x.a)) + y.c * (y.a * (1 - x.a)) / (x.a + y.a * (1 - x.a)) ELSE x.c END, 'a': x.a + y.a * (1 - x.a)} END) AS r FROM g)"""


@query(with_views("rays", body=FOLD + " SELECT pixel, round(r.c, 6) AS c, round(r.a, 6) AS a FROM f"))
def alpha_fold_rays(spark, d):
    """Opacity volume of each ray: samples folded front to back."""
    return view.alpha_volume(rays(spark, d), ["pixel"], 0.2, 0.0, 500.0, 0.5).select("pixel", r6(F.col("r")).alias("c"), r6(F.col("a")).alias("a"))


LIT = """+s AS (SELECT pixel, step, least(greatest(v / 500.0, 0), 1) AS rel, (w - 3) / sqrt((w - 3) * (w - 3) + 4) AS nx, 2 / sqrt((w - 3) * (w - 3) + 4) AS nz FROM rays),
n AS (SELECT *, CASE WHEN 0.6 * nx + 0.8 * nz < 0 THEN -nx ELSE nx END AS ax, CASE WHEN 0.6 * nx + 0.8 * nz < 0 THEN -nz ELSE nz END AS az FROM s),
i AS (SELECT *, greatest(0.6 * ax + 0.8 * az, 0) AS diff, greatest((0.6 * ax + 1.8 * az) / sqrt(0.36 + 3.24), 0) AS hn FROM n),
j AS (SELECT *, 0.2 + 0.6 * diff + 0.2 * CASE WHEN diff > 0 THEN power(hn, 8) ELSE 0 END AS light FROM i),
g AS (SELECT pixel, list({'c': rel * light, 'a': 1 - power(1 - 0.2 * rel, 0.5)} ORDER BY step) AS l FROM j WHERE 1 - power(1 - 0.2 * rel, 0.5) >= 1e-5 GROUP BY pixel)"""


@query(with_views("rays", body=LIT + FOLD[FOLD.index(",\nf AS") :] + " SELECT pixel, round(r.c, 6) AS r, round(r.c, 6) AS g, round(r.c, 6) AS b, round(r.a, 6) AS a FROM f"))
def alpha_fold_lit_rays(spark, d):
    """The same, lit from one side: the normal by a second field, turned to the light."""
    length = F.sqrt((F.col("w") - 3) * (F.col("w") - 3) + 4)
    light = [F.lit(0.6), F.lit(0.0), F.lit(0.8)]
    normal = colors.facing([(F.col("w") - 3) / length, F.lit(0.0), 2 / length], light)
    grey = colors.blinn(normal, light, [F.lit(0.0), F.lit(0.0), F.lit(1.0)], 0.2, 0.6, 0.2, 8.0)
    return view.alpha_volume(rays(spark, d), ["pixel"], 0.2, 0.0, 500.0, 0.5, light=grey).select("pixel", *(r6(F.col(c)).alias(c) for c in "rgba"))


@query(with_views("rays", body="SELECT pixel, round(0.5, 6) AS r, round(1 - power(0.75, least(count(*), 20)), 6) AS a FROM rays GROUP BY pixel"))
def domain_voxels_rays(spark, d):
    """A constant colour for each defined sample: opaque after 20 of them at this alpha."""
    return view.domain_voxels(rays(spark, d), ["pixel"], (0.5, 0.5, 0.5, 0.25)).select("pixel", r6(F.col("r")).alias("r"), r6(F.col("a")).alias("a"))


PIXELS = "+px AS (SELECT CAST(pixel % 16 AS INT) AS x, CAST(pixel // 16 AS INT) AS y, CAST(floor(max(v)) AS BIGINT) % 256 AS a, CAST(floor(min(v)) AS BIGINT) % 256 AS r, count(*) % 256 AS g, CAST(floor(avg(v)) AS BIGINT) % 256 AS b FROM rays GROUP BY pixel)"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    p = rays(spark, d).groupBy("pixel").agg(F.max("v").alias("hi"), F.min("v").alias("lo"), F.count("*").alias("n"), F.avg("v").alias("m"))
    return p.select((F.col("pixel") % 16).cast("int").alias("x"), F.floor(F.col("pixel") / 16).cast("int").alias("y"), (F.floor("hi") % 256).alias("a"), (F.floor("lo") % 256).alias("r"), (F.col("n") % 256).alias("g"), (F.floor("m") % 256).alias("b"))


@query(with_views("rays", body=PIXELS + """ SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y, CAST((coalesce(r, 0) * coalesce(a, 0) + 10 * (255 - coalesce(a, 0))) // 255 AS INT) AS r, CAST((coalesce(g, 0) * coalesce(a, 0) + 20 * (255 - coalesce(a, 0))) // 255 AS INT) AS g, CAST((coalesce(b, 0) * coalesce(a, 0) + 30 * (255 - coalesce(a, 0))) // 255 AS INT) AS b
FROM (SELECT unnest(generate_series(0, 15)) AS i) p, (SELECT unnest(generate_series(0, 11)) AS j) q LEFT JOIN px ON px.x = i AND px.y = j"""))
def compose_background_rays(spark, d):
    lattice = mesh.odometer(spark, [16, 12], ["x", "y"]).drop("id")
    return view.compose(_pixels(spark, d), lattice, ["x", "y"], (10, 20, 30))


@query(with_views("rays", body=PIXELS + " SELECT min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM px WHERE a > 0"))
def crop_rect_rays(spark, d):
    return view.crop(_pixels(spark, d))


@query(with_views("rays", body="""+p AS (SELECT pixel % 8 AS x, CAST(pixel AS BIGINT) AS o, CAST(floor(max(v)) AS BIGINT) % 256 AS a, CAST(floor(min(v)) AS BIGINT) % 256 AS r FROM rays GROUP BY pixel),
g AS (SELECT x, list({'a': a, 'r': r} ORDER BY o) AS l FROM p GROUP BY x),
f AS (SELECT x, list_reduce(list_prepend({'a': 0::BIGINT, 'r': 0::BIGINT}, l), lambda d, s: CASE WHEN s.a = 0 THEN d WHEN s.a = 255 THEN s WHEN d.a = 0 THEN s ELSE {'a': s.a + d.a * (255 - s.a) // 255, 'r': (s.r * s.a + d.r * (s.a + d.a * (255 - s.a) // 255 - s.a)) // greatest(s.a + d.a * (255 - s.a) // 255, 1)} END) AS q FROM g)
SELECT x, q.a AS a, q.r AS r FROM f"""))
def blend_parts_rays(spark, d):
    """8-bit parts of eight pixels, composed in order in integers."""
    p = rays(spark, d).groupBy("pixel").agg((F.floor(F.max("v")) % 256).alias("a"), (F.floor(F.min("v")) % 256).alias("r"))
    parts = p.select((F.col("pixel") % 8).alias("x"), F.col("pixel").alias("order"), "a", "r", F.lit(0).alias("g"), F.lit(0).alias("b"))
    return view.blend_parts(parts, ["x"]).select("x", "a", "r")


@query(with_views("rays", body="SELECT pixel % 16 AS x, max(v) AS t FROM rays GROUP BY 1"))
def merge_max_rays(spark, d):
    return view.merge_max(rays(spark, d).select((F.col("pixel") % 16).alias("x"), F.col("v").alias("t")), ["x"])


@query(with_views("pts3", body="SELECT zone, count(*) AS points FROM pts3 WHERE NOT ((x - 25) * 1.0 + (y - 25) * 0.0 + (z - 25) * 0.0 > 0) AND NOT ((x - 0) * 0.0 + (y - 10) * -1.0 + (z - 0) * 0.0 > 0) GROUP BY zone"))
def clip_planes_pts3(spark, d):
    p = pts3(spark, d)
    keep = boxes.clip_planes([p["x"], p["y"], p["z"]], [((25, 25, 25), (1.0, 0.0, 0.0)), ((0, 10, 0), (0.0, -1.0, 0.0))])
    return p.where(keep).groupBy("zone").agg(F.count("*").alias("points"))


def _order_sql(dim: int, n: int, eye: float) -> str:
    """The order key in SQL, for an eye with equal coordinates inside the cube."""
    at = int(eye * n)
    axes = "xyz"[:dim]
    digit = lambda a: f"CASE WHEN {a} < {at} THEN 0 WHEN {a} > {at} THEN 2 ELSE 1 END"
    place = lambda a: f"CASE WHEN {a} < {at} THEN {a} WHEN {a} > {at} THEN {n - 1} - {a} ELSE 0 END"
    code = " + ".join(f"({digit(a)}) * {3**k}" for k, a in enumerate(axes))
    rank = "CASE code " + " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(order.macro_order(dim))) + " END"
    series = ", ".join(f"(SELECT CAST(unnest(generate_series(0, {n - 1})) AS INT) AS {a}) s{a}" for a in axes)
    key = f"{rank}, {' + '.join(f'p{a}' for a in axes)}" + (", pz" if dim == 3 else "") + ", py"
    return f"WITH c AS (SELECT *, {code} AS code, {', '.join(f'{place(a)} AS p{a}' for a in axes)} FROM {series}) SELECT {', '.join(axes)}, row_number() OVER (ORDER BY {key}) - 1 AS number FROM c"


@query(_order_sql(2, 8, 0.49))
def order_back_to_front_2d(spark, d):
    return order.back_to_front(mesh.odometer(spark, [8, 8], ["x", "y"]).drop("id"), ["x", "y"], 8, (0.49, 0.49))


@query(_order_sql(3, 4, 0.49))
def order_back_to_front_3d(spark, d):
    return order.back_to_front(mesh.odometer(spark, [4, 4, 4], ["x", "y", "z"]).drop("id"), ["x", "y", "z"], 4, (0.49, 0.49, 0.49))


@query(with_views("pts2", body="SELECT id, CASE WHEN y <= 20 THEN 3 WHEN y >= 80 THEN 15 ELSE CAST(floor((y - 20) * 12 / 60) AS INT) + 3 END AS before_end, CASE WHEN y > 20 AND y < 80 THEN CAST(floor((y - 20) * 12 / 60) AS INT) + 3 END AS at_index, CASE WHEN y <= 20 THEN 3 WHEN y >= 80 THEN 15 ELSE CAST(floor((y - 20) * 12 / 60) AS INT) + 4 END AS after_start FROM pts2"))
def range_split_uniform(spark, d):
    return pts2(spark, d).select("id", *(c.alias(n) for n, c in order.split_columns(F.col("y"), 20.0, 80.0, 3, 15).items()))


@query(with_views("pts2", body="+k AS (SELECT id, y, 5 + (y > 30)::INT + (y > 50)::INT + (y > 70)::INT AS a FROM pts2) SELECT id, CASE WHEN y <= 20 THEN 5 WHEN y >= 80 THEN 9 ELSE a END AS before_end, CASE WHEN y > 20 AND y < 80 THEN a END AS at_index, CASE WHEN y <= 20 THEN 5 WHEN y >= 80 THEN 9 ELSE a + 1 END AS after_start FROM k"))
def range_split_nonuniform(spark, d):
    return pts2(spark, d).select("id", *(c.alias(n) for n, c in order.split_cut_columns(F.col("y"), 20.0, 80.0, 5, [30.0, 50.0, 70.0]).items()))


@query("SELECT CAST(x * 16 // 12 AS INT) AS x0, CAST((x + 1) * 16 // 12 AS INT) AS x1, 0 AS y0, 16 AS y1, 0 AS z0, 16 AS z1 FROM (SELECT unnest(generate_series(0, 11)) AS x) t")
def cube_split(spark, d):
    """The index cube of level 4 in twelve boxes."""
    rows = [(a[0], b[0], a[1], b[1], a[2], b[2]) for a, b in order.split_cube(4, 12)]
    return spark.createDataFrame(rows, "x0 int, x1 int, y0 int, y1 int, z0 int, z1 int")


KNOTS = [(0.0, 0.0, 0.0, 1.0, 0.0), (50.0, 0.0, 1.0, 0.0, 0.5), (200.0, 1.0, 0.0, 0.0, 1.0)]


@query(with_views("rays", body="SELECT pixel, CAST(step AS INT) AS step, round(CASE WHEN v < 50 THEN 0.0 WHEN v < 200 THEN (v - 50) / 150 ELSE 1.0 END, 6) AS r, round(CASE WHEN v < 50 THEN v / 50 WHEN v < 200 THEN 1 - (v - 50) / 150 ELSE 0.0 END, 6) AS g, round(CASE WHEN v < 50 THEN 1 - v / 50 ELSE 0.0 END, 6) AS b, round(CASE WHEN v < 50 THEN 0.5 * (v / 50) WHEN v < 200 THEN 0.5 + 0.5 * ((v - 50) / 150) ELSE 1.0 END, 6) AS a FROM rays"))
def color_lut_rays(spark, d):
    return rays(spark, d).select("pixel", "step", *(r6(c).alias(n) for n, c in zip("rgba", colors.transfer(F.col("v"), KNOTS), strict=True)))


@query(with_views("rays", body="SELECT pixel, CAST(step AS INT) AS step, (CAST(floor(v / 500 * 255 + 0.5) AS BIGINT) * 16777216) + CAST(floor(w / 7 * 255 + 0.5) AS BIGINT) * 65536 AS packed, CAST(floor(v / 500 * 255 + 0.5) AS INT) AS a FROM rays"))
def pack_argb_rays(spark, d):
    p = colors.pack_round(F.col("w") / 7, F.lit(0.0), F.lit(0.0), F.col("v") / 500)
    return rays(spark, d).select("pixel", "step", p.alias("packed"), colors.unpack(p)[3].alias("a"))


@query(with_views("rays", body="SELECT pixel, CAST(step AS INT) AS step, CAST(floor(least(greatest(v / 500, 0), 1) * 65535 + 0.5) AS INT) AS q FROM rays"))
def quantize_rays(spark, d):
    return rays(spark, d).select("pixel", "step", colors.quantize(F.col("v"), 0.0, 500.0)[0].alias("q"))


@query(with_views("rays", body="SELECT pixel, CAST(step AS INT) AS step, (v >= 20)::INT + (v >= 50)::INT + (v >= 120)::INT AS interval FROM rays"))
def find_interval_rays(spark, d):
    levels = order.sorted_level_column(F.array(F.lit(50.0), F.lit(20.0), F.lit(120.0), F.lit(50.0)))
    return rays(spark, d).select("pixel", "step", cells.find_interval(levels, F.col("v")).alias("interval"))


@query(with_views("pts2", "cube2", body=BLOCKS2 + " SELECT level, ix, iy FROM blocks2 WHERE level = 4"))
def level_filter_pts2(spark, d):
    """A level beyond the deepest is the deepest."""
    return view.progressive(_blocks2(spark, d)[2], 9, L2)


@query(with_views("emb3", body="""+k AS (SELECT id, CASE WHEN x = 0 THEN NULL ELSE (-1 - 0) / x END AS a1, x, y, z FROM emb3)
SELECT id, round(greatest(0.0, least(-1 / x, 1 / x), least(-1 / y, 1 / y), least(-1 / z, 1 / z)), 4) AS enter, round(least(greatest(-1 / x, 1 / x), greatest(-1 / y, 1 / y), greatest(-1 / z, 1 / z)), 4) AS leave FROM k WHERE x <> 0 AND y <> 0 AND z <> 0"""))
def ray_box_emb3(spark, d):
    """Rays from the origin along each vector through the cube [-1, 1]."""
    p = emb3(spark, d).where("x <> 0 and y <> 0 and z <> 0")
    zero, lo, hi = [F.lit(0.0)] * 3, [F.lit(-1.0)] * 3, [F.lit(1.0)] * 3
    enter, leave = view.ray_box(zero, [p["x"], p["y"], p["z"]], lo, hi, near=0.0)
    return p.select("id", F.round(enter, 4).alias("enter"), F.round(leave, 4).alias("leave"))


# -- scalar functions -------------------------------------------------------------------------


@query(with_views("pts2", "cube2", body=f"+k AS (SELECT id, {cell('x', 'mx', 4)} AS ix, {cell('y', 'my', 4)} AS iy FROM pts2, cube2) SELECT id, CAST(ix + iy * 16 AS BIGINT) AS block, CAST(ix + iy * 17 AS BIGINT) AS vertex, CAST({_morton2('ix', 'iy', 4)} AS BIGINT) AS morton, (ix & 1) + ((iy & 1) << 1) AS octant, ix >> 2 = 1 AND iy >> 2 = 2 AS below FROM k"))
def cell_numbers_pts2(spark, d):
    p = pts2(spark, d)
    ix, iy = cube_of(p, 2).cell([p["x"], p["y"]], 4)
    p = p.select("id", ix.alias("ix"), iy.alias("iy"))
    at = [F.col("ix"), F.col("iy")]
    return p.select("id", cells.block_ordinal(at, 4).alias("block"), cells.vertex_ordinal(at, 4).alias("vertex"), cells.morton(at, 4).alias("morton"), cells.octant(at).alias("octant"), cells.same_or_descendant(F.lit(4), at, F.lit(2), [F.lit(1), F.lit(2)]).alias("below"))


@query(with_views("emb3", body="""SELECT id, round(x * x + y * y + z * z, 4) AS n2, round(abs(x) + abs(y) + abs(z), 4) AS n1, round(greatest(abs(x), abs(y), abs(z)), 4) AS ninf, CASE WHEN abs(x) = greatest(abs(x), abs(y), abs(z)) THEN 0 WHEN abs(y) = greatest(abs(x), abs(y), abs(z)) THEN 1 ELSE 2 END AS axis,
round(y * 3 - z * 2, 4) AS cx, round(z * 1 - x * 3, 4) AS cy, round(x * 2 - y * 1, 4) AS cz, round(x * 1 + y * 2 + z * 3, 4) AS dot, x >= 0 OR y >= 0 AS some_ge FROM emb3"""))
def vector_functions_emb3(spark, d):
    p = emb3(spark, d)
    v, k = [p["x"], p["y"], p["z"]], [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    c = vectors.cross(v, k)
    some = vectors.compare_some(v[:2], [F.lit(0.0)] * 2, lambda a, b: a >= b)
    out = {"n2": vectors.norm2_squared(v), "n1": vectors.norm1(v), "ninf": vectors.norm_inf(v), "cx": c[0], "cy": c[1], "cz": c[2], "dot": vectors.dot(v, k)}
    return p.select("id", *(F.round(x, 4).alias(n) for n, x in out.items()), vectors.primary_axis(v).alias("axis"), some.alias("some_ge"))


@query(with_views("emb3", body="SELECT id, round((x * 2 - y * 1) / 3, 4) AS a, round((y * 2 - x * 1) / 3, 4) AS b FROM emb3"))
def cramer_emb3(spark, d):
    """[[2, 1], [1, 2]] times (a, b) is (x, y)."""
    p = emb3(spark, d)
    m = [[F.lit(2.0), F.lit(1.0)], [F.lit(1.0), F.lit(2.0)]]
    a, b = vectors.solve2(m, [p["x"], p["y"]])
    return p.select("id", F.round(a, 4).alias("a"), F.round(b, 4).alias("b"))


@query(with_views("pts2", body="SELECT id, x BETWEEN 10 AND 30 AND y BETWEEN 5 AND 50 AS inside, greatest(x, 10.0) AS lo_x, least(x + 5, 30.0) AS hi_x, NOT (greatest(x, 10.0) <= least(x + 5, 30.0) AND greatest(y, 5.0) <= least(y + 5, 50.0)) AS empty FROM pts2"))
def box_functions_pts2(spark, d):
    p = pts2(spark, d)
    box = ([F.lit(10.0), F.lit(5.0)], [F.lit(30.0), F.lit(50.0)])
    own = ([p["x"], p["y"]], [p["x"] + 5, p["y"] + 5])
    cut = boxes.intersection(own, box)
    return p.select("id", boxes.contains(box, [p["x"], p["y"]]).alias("inside"), cut[0][0].alias("lo_x"), cut[1][0].alias("hi_x"), boxes.is_empty(cut).alias("empty"))


@query("SELECT CAST(k AS BIGINT) AS id, CAST(k % 5 AS INT) AS i, CAST(k // 5 % 4 AS INT) AS j, CAST(k // 20 AS INT) AS k FROM (SELECT unnest(generate_series(0, 59)) AS k) t")
def odometer(spark, d):
    return mesh.odometer(spark, [5, 4, 3], ["i", "j", "k"])


@query("""WITH n AS (SELECT id, id % 11 AS i, id // 11 % 19 AS j, id // 209 AS k FROM (SELECT unnest(generate_series(0, 11 * 19 * 32 - 1)) AS id) t),
p AS (SELECT *, 0.1 + i / 10.0::DOUBLE * (0.18 / 1.1 + i / 10.0::DOUBLE * (0.81 / 1.1)) AS r, radians(10 + 160 * j / 18.0::DOUBLE) AS th, radians(270 * k / 31.0::DOUBLE) AS ph FROM n)
SELECT 0 AS zone_id, CAST(id AS BIGINT) AS node_id, round(2 * r * sin(th) * cos(ph), 6) AS x, round(r * sin(th) * sin(ph), 6) AS y, round(r * cos(th), 6) AS z,
round(sin(2 * pi() / (5 * r * 1.5)) * sin(1.5 * 8 * pi() * j / 18) * sin(1.5 * 16 * pi() * k / 31), 6) AS "F", round(r * sin(th) * cos(ph), 6) AS xx FROM p""")
def sphere_generator(spark, d):
    """About 6,000 nodes: 11 radii, 19 nutations, 32 azimuths."""
    s = readers.sphere(spark, 3, 6000, scale=(2.0, 1.0, 1.0), time=0.5)
    return s.select("zone_id", "node_id", *(r6(F.col(c)).alias(c) for c in ("x", "y", "z", "F", "xx")))


@query("""WITH n AS (SELECT id, id % 19 AS i, id // 19 AS j FROM (SELECT unnest(generate_series(0, 19 * 55 - 1)) AS id) t),
p AS (SELECT *, 0.1 + i / 18.0::DOUBLE * (0.18 / 1.1 + i / 18.0::DOUBLE * (0.81 / 1.1)) AS r, radians(270 * j / 54.0::DOUBLE) AS ph FROM n)
SELECT 0 AS zone_id, CAST(id AS BIGINT) AS node_id, round(r * cos(ph), 6) AS x, round(r * sin(ph), 6) AS y, round(sin(2 * pi() / (5 * r)) * sin(16 * pi() * j / 54), 6) AS "F", round(r * cos(ph), 6) AS xx FROM p""")
def circle_generator(spark, d):
    s = readers.sphere(spark, 2, 1000)
    return s.select("zone_id", "node_id", *(r6(F.col(c)).alias(c) for c in ("x", "y", "F", "xx")))


@query("""WITH n AS (SELECT id, id % 12 AS i, id // 12 % 12 AS j, id // 144 AS k FROM (SELECT unnest(generate_series(0, 1727)) AS id) t),
q AS (SELECT id, 4 * (1 - power(power(2.0::DOUBLE, 0.1), i)) / (1 - power(2.0::DOUBLE, 1.1)) - 2 AS x, -2 + 4 * j / 11.0::DOUBLE AS y, -2 + 4 * k / 11.0::DOUBLE AS z FROM n),
a AS (SELECT *, sqrt(x * x + y * y + z * z) AS r, sqrt(x * x + y * y) AS rxy FROM q),
f AS (SELECT *, CASE WHEN abs(x) + abs(y) < 2e-5 THEN 0 ELSE atan2(y, x) END AS ph, CASE WHEN rxy + abs(z) < 2e-5 THEN 0 ELSE atan2(rxy, z) END AS th FROM a)
SELECT 0 AS zone_id, CAST(id AS BIGINT) AS node_id, round(x, 6) AS x, round(3 * y, 6) AS y, round(z, 6) AS z,
round(sin(2 * pi() / (5 * greatest(r, 1e-10))) * sin(8 * th) * sin(8 * ph), 6) AS "F", round(x + 2 * y + 3 * z, 6) AS lin FROM f""")
def cube_generator(spark, d):
    c = readers.cube(spark, 3, 1728, half=2.0, ratios=(2.0, 1.0, 1.0), scale=(1.0, 3.0, 5.0))
    return c.select("zone_id", "node_id", *(r6(F.col(c)).alias(c) for c in ("x", "y", "z", "F", "lin")))


@query("""WITH p AS (SELECT id, (id % 8 - 4) / 8.0::DOUBLE AS x, (id // 8 % 8 - 4) / 8.0::DOUBLE AS y, (id // 64 + 1) / 8.0::DOUBLE AS z FROM (SELECT unnest(generate_series(0, 511)) AS id) t),
t AS (SELECT id, cos(0.5 * pi() * z) * x + sin(0.5 * pi() * z) * y AS a, -sin(0.5 * pi() * z) * x + cos(0.5 * pi() * z) * y AS b, z FROM p)
SELECT CAST(id AS BIGINT) AS id, round(sin(pi() * a / z) * sin(pi() * b / z) * sin(1 / z + pi() * 0.25) - z, 6) AS value FROM t""")
def wave_function(spark, d):
    p = mesh.odometer(spark, [8, 8, 8], ["i", "j", "k"])
    return p.select("id", r6(readers.waves((F.col("i") - 4) / 8, (F.col("j") - 4) / 8, (F.col("k") + 1) / 8, 0.25)).alias("value"))


# -- telemetry --------------------------------------------------------------------------------


@query(with_views("tele", body="SELECT count(DISTINCT frame) AS frames, (SELECT max(level) + 1 FROM tele WHERE frame = (SELECT min(frame) FROM tele)) AS levels FROM tele"))
def summary_tele(spark, d):
    return telemetry.summary(tele(spark, d))


@query(with_views("tele", body="SELECT n, frame, us - min(us) OVER (PARTITION BY frame) AS us FROM tele"))
def time_shift_tele(spark, d):
    return telemetry.shifted(tele(spark, d), ["us"], start="us").select("n", "frame", "us")


DURATIONS = "+d AS (SELECT *, lead(us) OVER (PARTITION BY frame, thread ORDER BY us, n) - us AS duration FROM tele)"


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.durations(tele(spark, d), ["frame", "thread"], ["us", "n"], "us")


@query(with_views("tele", body=DURATIONS + " SELECT n, duration FROM d"))
def stage_durations_tele(spark, d):
    return _durations(spark, d).select("n", "duration")


@query(with_views("tele", body="SELECT frame, thread, CAST(row_number() OVER (PARTITION BY frame, thread ORDER BY us, n) - 1 AS INT) AS pos, us AS time, stage AS type FROM tele"))
def stage_bars_tele(spark, d):
    return telemetry.bars(tele(spark, d), ["frame", "thread"], ["us", "n"], "us", "stage")


@query(with_views("tele", body=DURATIONS + " SELECT level, frame, max(us + coalesce(duration, 0)) - min(us) AS span, min(coalesce(duration, 0)) AS min_task, max(coalesce(duration, 0)) AS max_task FROM d GROUP BY level, frame"))
def task_duration_tele(spark, d):
    rows = _durations(spark, d).withColumn("end", F.col("us") + F.coalesce("duration", F.lit(0)))
    return telemetry.task_durations(rows, "us", "end")


TYPES = ["click", "error", "purchase", "signup", "view"]
STATS = ", ".join(f"count(CASE WHEN stage = '{t}' THEN v END) AS {t}_count, coalesce(min(CASE WHEN stage = '{t}' THEN v END), 0) AS {t}_min, coalesce(max(CASE WHEN stage = '{t}' THEN v END), 0) AS {t}_max, round(avg(CASE WHEN stage = '{t}' THEN v END), 8) AS {t}_avg" for t in TYPES)


def _stats(spark: SparkSession, d: str) -> DataFrame:
    s = telemetry.stage_statistics(tele(spark, d), ["level", "frame"], "stage", "v", TYPES)
    return s.select(*(F.round(c, 8).alias(c) if c.endswith("_avg") else c for c in s.columns))


@query(with_views("tele", body=f"SELECT level, frame, {STATS} FROM tele GROUP BY level, frame"))
def stage_stats_pivot_tele(spark, d):
    return _stats(spark, d)


FRAME_TABLE = "+t AS (SELECT level, frame, row_number() OVER (PARTITION BY level ORDER BY frame) - 1 AS frame_no, count(*) AS records, sum(v) AS total FROM tele GROUP BY level, frame)"


def _frame_table(spark: SparkSession, d: str) -> DataFrame:
    t = tele(spark, d).groupBy("level", "frame").agg(F.count("*").alias("records"), F.sum("v").alias("total"))
    return t.withColumn("frame_no", F.row_number().over(Window.partitionBy("level").orderBy("frame")) - 1)


@query(with_views("tele", body=FRAME_TABLE + " SELECT level, round(avg(records), 4) AS records, round(avg(total), 4) AS total FROM t WHERE frame_no BETWEEN 1 AND 9 GROUP BY level"))
def frame_avg_tele(spark, d):
    a, b = telemetry.frame_range("1-$", 10)
    t = telemetry.averaged(_frame_table(spark, d).drop("frame"), ["level"], a, b)
    return t.select("level", F.round("records", 4).alias("records"), F.round("total", 4).alias("total"))


@query(with_views("tele", body=f"SELECT click_avg, error_avg, purchase_avg, signup_avg, view_avg FROM (SELECT level, frame, {STATS} FROM tele GROUP BY level, frame) q"))
def regex_project_tele(spark, d):
    return telemetry.projected(_stats(spark, d), r"\w+_avg")


@query(with_views("tele", body=FRAME_TABLE + " SELECT level, round(avg(total), 4) AS total FROM t WHERE frame_no BETWEEN 0 AND 4 GROUP BY level"))
def average_then_project_tele(spark, d):
    return telemetry.averaged_and_projected(_frame_table(spark, d).drop("frame"), ["level"], 0, 4, "level|total").select("level", F.round("total", 4).alias("total"))


@query(with_views("tele", body="SELECT 'a' AS run, node, count(*) AS records FROM tele WHERE stage = 'click' GROUP BY node UNION ALL SELECT 'b', node, count(*) FROM tele WHERE stage = 'view' GROUP BY node"))
def union_sort_tele(spark, d):
    t = tele(spark, d)
    one = lambda stage, run: telemetry.labelled(t.where(F.col("stage") == stage).groupBy("node").agg(F.count("*").alias("records")), run=run)
    return telemetry.union_sorted([one("view", "b"), one("click", "a")], ["node", "run", "records"])


@query(with_views("tele", body="""+r AS (SELECT n, thread, CAST(floor((us / 1e6 - 1704067200) * 1000) AS BIGINT) AS x, CAST(floor((us / 1e6 - 1704067200 + v / 1000) * 1000) AS BIGINT) AS x1 FROM tele) SELECT n, x, thread * 8 AS y, x1 - x AS w, 8 AS h FROM r WHERE x1 - x > 0"""))
def timeline_rects_tele(spark, d):
    t = tele(spark, d).select("n", "thread", (F.col("us") / 1e6 - 1704067200).alias("start"), (F.col("v") / 1000).alias("len"))
    return telemetry.timeline(t, "start", "len", F.col("thread"), 8).select("n", "x", "y", "w", "h")


@query(with_views("tele", body="""+m AS (SELECT frame, max(us % 3600000000) AS m FROM tele GROUP BY frame), p AS (SELECT frame, lag(m) OVER (ORDER BY frame) AS b FROM m)
SELECT n FROM tele JOIN p USING (frame) WHERE CASE WHEN b IS NULL THEN us % 3600000000 <> 0 ELSE us % 3600000000 > b END"""))
def drop_stale_tele(spark, d):
    t = tele(spark, d).withColumn("start", F.col("us") % 3_600_000_000)
    return telemetry.without_stale(t).select("n")


@query(with_views("tele", body="+l AS (SELECT *, lag(v) OVER (PARTITION BY thread ORDER BY us, n) > v AS bad FROM tele) SELECT thread, count(CASE WHEN bad THEN 1 END) AS falls FROM l GROUP BY thread"))
def monotone_check_tele(spark, d):
    return telemetry.falls(tele(spark, d), ["thread"], ["us", "n"], "v")


@query(with_views("tele", body="SELECT n, stage FROM tele WHERE level = 1 AND node = 2"))
def level_node_filter_tele(spark, d):
    return telemetry.of_level(tele(spark, d), level=1, node=2).select("n", "stage")


# -- stateful ---------------------------------------------------------------------------------


@query(with_views("tele", body="SELECT node, max(n) AS n, arg_max(v, n) AS v FROM tele GROUP BY node"))
def latest_frame_tele(spark, d):
    return stateful.latest(tele(spark, d).select("node", "n", "v"), ["node"], "n")


@query(with_views("tele", body="+l AS (SELECT *, lag(frame) OVER (PARTITION BY thread ORDER BY us, n) AS b FROM tele) SELECT n FROM l WHERE b IS NULL OR b <> frame"))
def dedup_frames_tele(spark, d):
    return stateful.changed_only(tele(spark, d), ["thread"], ["us", "n"], "frame").select("n")


@query(with_views("tele", body="SELECT n, round(sum(v) OVER (PARTITION BY thread ORDER BY us, n ROWS 19 PRECEDING) / 20, 4) AS average FROM tele"))
def moving_avg20_tele(spark, d):
    return stateful.moving_average(tele(spark, d), ["thread"], ["us", "n"], "v").select("n", F.round("average", 4).alias("average"))


@query(with_views("tele", body="""+m AS (SELECT thread, us, n, sum(v / 100) OVER (PARTITION BY thread ORDER BY us, n ROWS 19 PRECEDING) / 20 AS a FROM tele),
g AS (SELECT thread, list(a ORDER BY us, n) AS l FROM m GROUP BY thread)
SELECT thread, CAST(list_reduce(list_prepend(50.0::DOUBLE, l), lambda q, a: greatest(10, least(100, q + CASE WHEN a > 0.5 THEN -1 WHEN a < 0.4 THEN 1 ELSE 0 END))) AS INT) AS quality FROM g"""))
def adaptive_quality_tele(spark, d):
    return stateful.adaptive_quality(tele(spark, d).withColumn("v", F.col("v") / 100), ["thread"], ["us", "n"], "v")


# The rule of the pressed left button, row by row: p and q are the times of the last press and the one before it.
CLICKS = """+e AS (SELECT n, thread, k, us // 1000000 % 400 + k * 150 AS ms, CASE WHEN k % 7 = 3 THEN 4 WHEN k % 2 = 1 THEN CASE WHEN v > 20 THEN 1 ELSE 2 END ELSE 0 END AS flags FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY us, n) AS k FROM tele) t),
g AS (SELECT thread, list({'n': n, 'ms': ms, 'f': flags, 'p': -100000, 'q': -100000, 'out': [{'n': n, 'c': false, 'd': false}]} ORDER BY k) AS l FROM e GROUP BY thread),
f AS (SELECT thread, list_reduce(list_prepend({'n': 0, 'ms': -100000, 'f': 0, 'p': -100000, 'q': -100000, 'out': [{'n': 0, 'c': false, 'd': false}]}, l), lambda a, x: {'n': x.n, 'ms': x.ms, 'f': x.f,
'p': CASE WHEN a.f = 0 AND x.f = 1 THEN x.ms WHEN x.f <> 0 AND x.f <> 1 THEN x.ms - 10000 ELSE a.p END,
'q': CASE WHEN a.f = 0 AND x.f = 1 THEN a.p WHEN x.f <> 0 AND x.f <> 1 THEN x.ms - 10000 ELSE a.q END,
'out': list_concat(a.out, [{'n': x.n, 'c': a.f = 1 AND x.f = 0 AND x.ms - a.p < 300, 'd': a.f = 1 AND x.f = 0 AND x.ms - a.q < 500}])}) AS r FROM g),
o AS (SELECT unnest(r.out) AS o FROM f)"""


@query(with_views("tele", body=CLICKS + " SELECT o.n AS n, o.c AS click, o.d AS double_click FROM o WHERE o.c OR o.d"))
def double_click_tele(spark, d):
    e = tele(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("thread").orderBy("us", "n")))
    flags = F.when(F.col("k") % 7 == 3, 4).when(F.col("k") % 2 == 1, F.when(F.col("v") > 20, 1).otherwise(2)).otherwise(0)
    e = e.select("n", "thread", "k", (F.floor(F.col("us") / 1_000_000) % 400 + F.col("k") * 150).alias("ms"), flags.alias("flags"))
    return stateful.clicks(e, ["thread"], ["k"], "ms", "flags").select("n", "click", "double_click")


@query(with_views("tele", body="SELECT n, round(v - lag(v) OVER (PARTITION BY thread, stage ORDER BY us, n), 4) AS d_v FROM tele"))
def drag_delta_tele(spark, d):
    return stateful.drag(tele(spark, d), ["thread", "stage"], ["us", "n"], ["v"]).select("n", F.round("d_v", 4).alias("d_v"))


@query(with_views("tele", body="""+l AS (SELECT n, row_number() OVER w = 1 AS f, lag(stage) OVER w IS NOT DISTINCT FROM stage AS s, lag(frame) OVER w IS NOT DISTINCT FROM frame AS r FROM tele WINDOW w AS (PARTITION BY thread ORDER BY us, n))
SELECT n, (CASE WHEN f OR NOT s THEN 1 ELSE 0 END) + (CASE WHEN f OR NOT r THEN 2 ELSE 0 END) AS flags FROM l"""))
def change_flags_tele(spark, d):
    return stateful.change_flags(tele(spark, d), ["thread"], ["us", "n"], {"view": ["stage"], "time": ["frame"]}).select("n", "flags")


@query(with_views("tele", body="""+l AS (SELECT thread, us, CASE WHEN us - lag(us) OVER (PARTITION BY thread ORDER BY us) >= 21600000000 OR lag(us) OVER (PARTITION BY thread ORDER BY us) IS NULL THEN 1 ELSE 0 END AS s FROM tele),
g AS (SELECT thread, us, sum(s) OVER (PARTITION BY thread ORDER BY us) AS k FROM l)
SELECT thread, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS events FROM g GROUP BY thread, k"""))
def session_timeout_tele(spark, d):
    """Keep-alive interval of four hours: a session ends after six hours of silence."""
    t = tele(spark, d).select("thread", F.timestamp_micros("us").alias("ts"))
    return stateful.sessions(t, "thread", "ts", 4 * 3600).select("thread", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query(with_views("tele", body="""+g AS (SELECT thread, list({'last': us // 1000, 'sent': [us // 1000]} ORDER BY us // 1000) AS l FROM tele GROUP BY thread),
f AS (SELECT thread, list_reduce(l, lambda a, x: CASE WHEN x.last - a.last >= 3600000 THEN {'last': x.last, 'sent': list_concat(a.sent, x.sent)} ELSE a END) AS r FROM g)
SELECT thread, unnest(r.sent) AS ms FROM f"""))
def push_throttle_tele(spark, d):
    """At most one frame for each hour and thread."""
    return stateful.throttled(tele(spark, d).withColumn("ms", F.floor(F.col("us") / 1000)), ["thread"], "ms", 3_600_000)


@query(with_views("tele", body="""+k AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY us, n) AS k FROM tele),
g AS (SELECT thread, list({'sent': 0, 'skipped': 0, 'c': CAST(k // 4 AS BIGINT), 'send': stage <> 'view'} ORDER BY k) AS l FROM k GROUP BY thread),
f AS (SELECT thread, list_reduce(list_prepend({'sent': 0, 'skipped': 0, 'c': CAST(-1 AS BIGINT), 'send': false}, l), lambda a, x: {'sent': CASE WHEN x.send AND a.c + 3 > a.sent THEN a.sent + 1 ELSE a.sent END, 'skipped': CASE WHEN x.send AND a.c + 3 <= a.sent THEN a.skipped + 1 ELSE a.skipped END, 'c': CASE WHEN x.send THEN a.c ELSE x.c END, 'send': false}) AS r FROM g)
SELECT thread, r.sent AS sent, r.skipped AS skipped, r.c AS confirmed FROM f"""))
def back_pressure_tele(spark, d):
    """Views acknowledge all frames up to a number, everything else is a sender's tick."""
    k = F.row_number().over(Window.partitionBy("thread").orderBy("us", "n"))
    t = tele(spark, d).withColumn("kind", F.when(F.col("stage") == "view", "ack").otherwise("send")).withColumn("number", F.floor(k / 4))
    return stateful.pending(t, ["thread"], ["us", "n"], "kind", "number")


@query(with_views("tele", body="SELECT n, CASE WHEN stage = 'click' THEN 'subscribe' WHEN stage = 'view' THEN 'ack' ELSE 'unknown' END AS kind, CASE WHEN stage IN ('click', 'view') THEN CAST(node AS VARCHAR) END AS argument FROM tele"))
def client_protocol_tele(spark, d):
    text = F.concat(F.when(F.col("stage") == "click", "s:").when(F.col("stage") == "view", "n:").otherwise("?"), F.col("node").cast("string"))
    return stateful.dispatched(tele(spark, d).withColumn("m", text), "m").select("n", "kind", "argument")


@query(with_views("frames", body="""+f AS (SELECT DISTINCT frame FROM frames), q AS (SELECT unnest([1.5, 23650.2, 23999.9, 24011.5]) AS t)
SELECT CAST(t AS DOUBLE) AS t, arg_min(frame, abs(frame - t) * 1000000 + frame) AS frame FROM f, q GROUP BY t"""))
def nearest_time_frames(spark, d):
    from octavo.plans.view import nearest_time

    f = frames(spark, d).select("frame").distinct().withColumn("t", F.col("frame").cast("double"))
    q = spark.createDataFrame([(1.5,), (23650.2,), (23999.9,), (24011.5,)], "t double")
    return nearest_time(q, f, "t", "frame")


@query(with_views("grid2", body="SELECT ix AS nx, iy AS ny, round(CASE WHEN ix % 2 = 0 THEN v ELSE ix / 16.0 + iy / 8.0 END, 6) AS value FROM grid2"))
def exact_field_grid2(spark, d):
    """A linear function where children have no value; theirs (even columns) are kept."""
    g = grid2(spark, d).select(F.col("ix").alias("nx"), F.col("iy").alias("ny"), "v")
    covered = g.where("nx % 2 = 0").select("nx", "ny", F.col("v").alias("value"))
    return fields.exact_field(g.select("nx", "ny"), covered, ["nx", "ny"], F.col("nx") / 16 + F.col("ny") / 8).select("nx", "ny", r6(F.col("value")).alias("value"))


@query(with_views("elem2", "grid2", body="""+k AS (SELECT n0 % 17 + CAST(a AS INT) AS x, n0 // 17 + CAST(b AS INT) AS y, CASE WHEN a = 0 AND b = 0 THEN g0.v WHEN b = 0 THEN g1.v WHEN a = 0 THEN g3.v ELSE g2.v END AS v FROM elem2, (SELECT unnest(generate_series(0, 1)) AS a) p, (SELECT unnest(generate_series(0, 1)) AS b) q, grid2 g0, grid2 g1, grid2 g2, grid2 g3 WHERE g0.node_id = n0 AND g1.node_id = n1 AND g2.node_id = n2 AND g3.node_id = n3)
SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(avg(v), 4) AS v, count(*) AS n FROM k GROUP BY 1, 2"""))
def refined_values_grid2(spark, d):
    """Refined elements with the field interpolated; lattice points that elements share agree."""
    r = interpolate.refined_points(_elements(spark), grid2(spark, d), "v", 2, 1.0)
    return r.groupBy("x", "y").agg(F.round(F.avg("v"), 4).alias("v"), F.count("*").alias("n"))


@query(with_views("grid2", body="SELECT ix AS nx, iy AS ny FROM grid2 WHERE ix >= 3 AND ix < 9 AND iy >= 2 AND iy < 5"))
def index_box_grid2(spark, d):
    g = grid2(spark, d).select(F.col("ix").alias("nx"), F.col("iy").alias("ny"))
    return interpolate.nodes_in_box(g, (3, 2), (9, 5))


@query(with_views("elem2", body="SELECT zone_id, element_id, CAST(n0 % 17 + a AS INT) AS nx, CAST(n0 // 17 + b AS INT) AS ny FROM elem2, (SELECT unnest(generate_series(0, 1)) AS a) p, (SELECT unnest(generate_series(0, 1)) AS b) q WHERE n0 % 17 + a >= 8"))
def uncovered_candidates_grid2(spark, d):
    """Element to node candidates, without the nodes that a child has covered (the left half)."""
    e, nodes, cube = _half(spark, d)
    covered = grid2(spark, d).where("ix < 8").select(F.col("ix").alias("nx"), F.col("iy").alias("ny"))
    return interpolate.without_covered(interpolate.candidates(e, nodes, cube, 4), covered, 2).select("zone_id", "element_id", "nx", "ny")


@query(with_views("grid2", body="""+b AS (SELECT ix AS nx, iy AS ny, CASE WHEN ix < 8 THEN 0 ELSE 1 END AS half, avg(ix - p) AS d FROM grid2, (SELECT unnest([3.5, 10.5]) AS p) q GROUP BY 1, 2, 3),
s AS (SELECT half, max(CASE WHEN d > 0 THEN d END) AS hi, max(CASE WHEN d < 0 THEN -d END) AS lo FROM b GROUP BY half)
SELECT half, nx, ny, round(CASE WHEN hi IS NULL OR lo IS NULL THEN d WHEN d > 0 THEN d / hi ELSE d / lo END, 6) AS value FROM b JOIN s USING (half)"""))
def boundary_shape_grid2(spark, d):
    """Signed distance of lattice nodes to two walls across x, scaled within each half that has both signs."""
    g = grid2(spark, d).select(F.when(F.col("ix") < 8, 0).otherwise(1).alias("half"), F.col("ix").alias("nx"), F.col("iy").alias("ny"), "x", "y")
    walls = g.select("half", "nx", "ny", F.explode(F.array(F.lit(3.5), F.lit(10.5))).alias("p_x"), F.lit(0.0).alias("p_y"), F.lit(1.0).alias("n_x"), F.lit(0.0).alias("n_y"))
    out = fields.boundary_shape(walls, g, ["half"], 2)
    return out.select("half", "nx", "ny", r6(F.col("value")).alias("value"))


@query(with_views("rays", body="SELECT x, max(t) AS t FROM (SELECT pixel % 16 AS x, max(v) AS t FROM rays WHERE step % 2 = 0 GROUP BY 1 UNION ALL SELECT pixel % 16, max(v) FROM rays WHERE step % 2 = 1 GROUP BY 1) q GROUP BY x"))
def assemble_pair_rays(spark, d):
    """Two partial images of maxima put together."""
    r = rays(spark, d).withColumn("x", F.col("pixel") % 16)
    part = lambda k: view.merge_max(r.where(F.col("step") % 2 == k).select("x", F.col("v").alias("t")), ["x"])
    return view.assemble(part(0), part(1), ["x"], mip=True)


@query(ORACLES["adaptive_quality_tele"])
def adaptive_quality_stream_tele(spark, d):
    """The quality control as a stream: state in ``applyInPandasWithState``, run to the end of the input."""
    source = f"{d}/events.parquet"
    schema = spark.read.parquet(source).schema
    folder, _, name = source.rpartition("/")
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    order = F.expr("datediff(cast(ts as date), date'1970-01-01') * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + cast(extract(second from ts) * 1000000 as bigint)")
    stream = raw.select(F.col("user_id").alias("thread"), (F.col("value") / 100).alias("v"), order.alias("order"), F.col("event_id").alias("n"))
    at = new_path(spark, "quality")
    keep_batch = lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/out/part={batch}")
    q = stateful.adaptive_quality_stream(stream, "thread", "v", order=("order", "n")).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(keep_batch).trigger(availableNow=True).start()
    q.awaitTermination()
    # the last that each batch said of a thread
    return spark.read.parquet(f"{at}/out").groupBy("thread").agg(F.max_by("quality", "batch").alias("quality"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Weighted corner means of the 3-D points, each with its subtree's value range."""
    p = pts3(spark, d)
    values = fields.corner_mean(p, cube_of(p, 3), 3, "v")
    root = [cells.right(F.least(F.col(n), F.lit(7)), 1).alias(f"b{n[1]}") for n in ("nx", "ny", "nz")]
    values = values.select("nx", "ny", "nz", "value", *root)
    return values.join(fields.field_range(values, ["bx", "by", "bz"]), ["bx", "by", "bz"])


from octavo.plans import queries_files, queries_mesh  # noqa: E402, F401  (they register themselves)
