"""Meshes: element generators, faces, simplices, boundary, refinement, tables about a mesh.

nodes: (zone_id, node_id, x[, y, z], fields...); elements: (zone_id, element_id, etype, nodes array, null = missing node).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octavo.functions.cells import axes
from octavo.functions.prefix import rank_before

# Local node numbers of faces and simplices by element subtype (counter-clockwise, faces outward).
FACES = {
    "triangle": [(0, 1), (1, 2), (2, 0)],
    "quad": [(3, 0), (1, 2), (0, 1), (2, 3)],
    "tetrahedron": [(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)],
    "pyramid": [(0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)],
    "prism": [(0, 2, 1), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5)],
    "hexahedron": [(0, 4, 7, 3), (1, 2, 6, 5), (0, 1, 5, 4), (3, 7, 6, 2), (0, 3, 2, 1), (4, 5, 6, 7)],
}
SIMPLICES = {
    "triangle": [(0, 1, 2)],
    "quad": [(0, 1, 2), (0, 2, 3)],
    "tetrahedron": [(0, 1, 2, 3)],
    "pyramid": [(0, 1, 2, 4), (0, 2, 3, 4)],
    "prism": [(0, 1, 2, 3), (1, 4, 5, 3), (1, 5, 2, 3)],
    "hexahedron": [(1, 4, 3, 0), (1, 3, 6, 2), (1, 6, 4, 5), (3, 4, 6, 7), (1, 3, 4, 6)],
}
# Which node takes the place of a missing one, by subtype.
FILLED = {"triangle": [0, 1, 2, 0], "tetrahedron": [0, 1, 2, 3, 0, 3, 3, 3], "pyramid": [0, 1, 2, 3, 4, 4, 4, 4], "prism": [0, 1, 2, 3, 4, 5, 0, 3]}
SPACE = {"triangle": 2, "quad": 2, "tetrahedron": 3, "pyramid": 3, "prism": 3, "hexahedron": 3}


def odometer(spark: SparkSession, sizes: list[int], names: list[str]) -> DataFrame:
    """All index vectors below ``sizes``, the first axis fastest: one range, taken apart by division."""
    total = reduce(lambda a, b: a * b, sizes, 1)
    rows, stride, out = spark.range(total), 1, []
    for n, name in zip(sizes, names, strict=True):
        out.append((F.floor(F.col("id") / stride) % n).cast("int").alias(name))
        stride *= n
    return rows.select("id", *out)


def structured_elements(spark: SparkSession, ijk: list[int], zone: int = 0) -> DataFrame:
    """Cells of an ordered zone with nodes numbered i fastest: 4 or 8 node numbers, counter-clockwise."""
    dim = len(ijk)
    cells = odometer(spark, [n - 1 for n in ijk], ["i", "j", "k"][:dim])
    strides = [1, ijk[0], ijk[0] * (ijk[1] if dim > 1 else 1)]
    base = reduce(lambda a, b: a + b, [F.col(c).cast("long") * s for c, s in zip("ijk", strides[:dim], strict=False)])
    ring = [0, 1, 1 + ijk[0], ijk[0]]
    offsets = ring if dim == 2 else ring + [r + strides[2] for r in ring]
    etype = "quad" if dim == 2 else "hexahedron"
    return cells.select(F.lit(zone).alias("zone_id"), F.col("id").alias("element_id"), F.lit(etype).alias("etype"), F.array(*(base + o for o in offsets)).alias("nodes"))


def with_subtype(elements: DataFrame) -> DataFrame:
    """Subtype from which nodes are there: quads may be triangles, hexahedra tetrahedra, pyramids or prisms."""
    has = lambda i: F.get("nodes", F.lit(i)).isNotNull()
    kind = F.col("etype")
    sub = F.when(kind == "quad", F.when(has(3), "quad").otherwise("triangle"))
    sub = sub.when(kind == "hexahedron", F.when(has(7), "hexahedron").when(has(5), "prism").when(has(4), "pyramid").otherwise("tetrahedron"))
    return elements.withColumn("subtype", sub.otherwise(kind))


def _table(local: dict[str, list[tuple[int, ...]]]) -> Column:
    """The rows of a fixed table for the element's subtype, as arrays of its node numbers. The table itself is a literal."""
    rows = None
    for name, table in local.items():
        literal = F.array(*(F.array(*(F.lit(i) for i in row)) for row in table))
        rows = F.when(F.col("subtype") == name, literal) if rows is None else rows.when(F.col("subtype") == name, literal)
    return F.transform(rows, lambda row: F.transform(row, lambda i: F.get("nodes", i)))


def faces(elements: DataFrame) -> DataFrame:
    """Every element's faces: zone_id, element_id, face number, its nodes."""
    rows = with_subtype(elements).withColumn("_f", _table(FACES))
    return rows.select("zone_id", "element_id", F.posexplode("_f").alias("face", "nodes"))


def simplices(elements: DataFrame) -> DataFrame:
    """Every element cut into triangles or tetrahedra: zone_id, element_id, simplex number, its nodes."""
    rows = with_subtype(elements).withColumn("_s", _table(SIMPLICES))
    return rows.select("zone_id", "element_id", F.posexplode("_s").alias("simplex", "nodes"))


def completed(elements: DataFrame) -> DataFrame:
    """Elements with missing nodes replaced by the ones they coincide with."""
    rows = with_subtype(elements)
    nodes = F.col("nodes")
    for name, order in FILLED.items():
        nodes = F.when((F.col("subtype") == name) & (F.size("nodes") == len(order)), F.array(*(F.get("nodes", F.lit(i)) for i in order))).otherwise(nodes)
    return rows.withColumn("nodes", nodes)


def canonical(face: Column) -> Column:
    """A face begun at its smallest node, orientation kept (for 2-node faces too)."""
    at = F.array_position(face, F.array_min(face)).cast("int")
    return F.concat(F.slice(face, at, F.size(face)), F.slice(face, F.lit(1), at - 1))


def reversed_face(face: Column) -> Column:
    """The canonical form of the face seen from the other side: the first node stays, the others are reversed."""
    return F.concat(F.slice(face, 1, 1), F.reverse(F.slice(face, F.lit(2), F.greatest(F.size(face) - 1, F.lit(0)))))


def boundary_faces(elements: DataFrame) -> DataFrame:
    """Faces that no other element of the zone has from the other side."""
    rows = faces(elements).withColumn("_k", canonical(F.col("nodes")))
    # begun at the smallest node, an edge has one form; a face and its reverse are told apart by the second node
    rows = rows.withColumn("_key", F.least("_k", reversed_face(F.col("_k"))))
    once = rows.groupBy("zone_id", "_key").agg(F.count("*").alias("_n"), F.first("element_id").alias("element_id"), F.first("face").alias("face"), F.first("nodes").alias("nodes")).where("_n = 1")
    return once.select("zone_id", "element_id", "face", "nodes")


def boundary_nodes(bfaces: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Distinct boundary nodes of each zone with dense new numbers in the order of the old ones."""
    ids = bfaces.select("zone_id", F.explode("nodes").alias("node_id")).where("node_id is not null").distinct()
    return rank_before(ids, ["zone_id"], F.floor(F.col("node_id") / chunk), [F.col("node_id")], "number")


def renumbered(bfaces: DataFrame, numbers: DataFrame) -> DataFrame:
    """Boundary faces in new numbers; a missing corner is its neighbour."""
    rows = bfaces.select("zone_id", "element_id", "face", F.posexplode("nodes").alias("pos", "node_id"))
    rows = rows.join(numbers, ["zone_id", "node_id"], "left")
    by = rows.groupBy("zone_id", "element_id", "face").agg(F.sort_array(F.collect_list(F.struct("pos", "number"))).alias("n"))
    filled = F.transform("n", lambda x, i: F.coalesce(x["number"], F.get(F.col("n"), i - 1)["number"]))
    return by.select("zone_id", "element_id", "face", filled.alias("nodes"))


def boundary_elements(elements: DataFrame, bfaces: DataFrame) -> DataFrame:
    return elements.join(bfaces.select("zone_id", "element_id").distinct(), ["zone_id", "element_id"], "left_semi")


def checked(elements: DataFrame, dim: int) -> DataFrame:
    """Elements whose type belongs to the space's dimension; others are an error."""
    rows = with_subtype(elements)
    space = reduce(lambda acc, kv: acc.when(F.col("subtype") == kv[0], kv[1]), list(SPACE.items())[1:], F.when(F.col("subtype") == "triangle", SPACE["triangle"]))
    return rows.where(F.when(space == dim, True).otherwise(F.raise_error(F.concat(F.lit("element type does not fit the space: "), F.col("subtype")))))


def element_nodes(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each element and node that it has, with the node's columns."""
    return elements.select("zone_id", "element_id", F.posexplode("nodes").alias("pos", "node_id")).where("node_id is not null").join(nodes, ["zone_id", "node_id"])


def element_boxes(elements: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """Bounding box and size (largest edge) of each element."""
    rows = element_nodes(elements, nodes)
    boxes = rows.groupBy("zone_id", "element_id").agg(*(f(a).alias(f"{n}_{a}") for a in axes(dim) for n, f in (("min", F.min), ("max", F.max))))
    edges = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in axes(dim)]
    return boxes.withColumn("size", F.greatest(*edges) if dim > 1 else edges[0])


def counts(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Nodes and elements of each zone."""
    n = nodes.groupBy("zone_id").agg(F.count("*").alias("nodes"))
    e = elements.groupBy("zone_id").agg(F.count("*").alias("elements"))
    return n.join(e, "zone_id", "full_outer").select("zone_id", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("elements", F.lit(0)).alias("elements"))


def mesh_info(zones: DataFrame) -> DataFrame:
    """Zone table with a total row (zone null). zones: zone, etype, elements, nodes."""
    return zones.rollup("zone").agg(F.when(F.grouping("zone") == 0, F.first("etype")).alias("etype"), F.sum("elements").alias("elements"), F.sum("nodes").alias("nodes"))


def element_shapes(elements: DataFrame, nodes: DataFrame, dim: int, param: float, fields: tuple[str, ...] = ()) -> DataFrame:
    """How each element is refined: its corners ``k`` (pos, axes, fields), ``whole``, the step ``size`` and intervals ``n_*``.

    The directions are the edges from an element's first node, of which the shortest and the longest give the step by
    ``param`` between them; each has max(1, round(length / step)) intervals. Elements that lack nodes, and simplices,
    are not whole: one interval each way, and the largest edge of their box as size.
    """
    names = [*axes(dim), *fields]
    rows = element_nodes(elements, nodes.select("zone_id", "node_id", *names))
    box = [(F.max(a) - F.min(a)).alias(f"_b_{a}") for a in axes(dim)]
    rows = rows.groupBy("zone_id", "element_id").agg(F.sort_array(F.collect_list(F.struct("pos", *names))).alias("k"), *box)
    at = lambda i, n: F.get("k", F.lit(i))[n]
    rows = rows.withColumn("whole", F.size("k") == 1 << dim)
    edge = [F.sqrt(reduce(lambda x, y: x + y, [(at(i, a) - at(0, a)) * (at(i, a) - at(0, a)) for a in axes(dim)])) for i in (1, 3, 4)[:dim]]
    rows = rows.select("*", *(e.alias(f"_e_{a}") for e, a in zip(edge, axes(dim), strict=True)))
    edges = [F.col(f"_e_{a}") for a in axes(dim)]
    step = F.least(*edges) + param * (F.greatest(*edges) - F.least(*edges))
    rows = rows.withColumn("size", F.when(F.col("whole"), step).otherwise(F.greatest(*(f"_b_{a}" for a in axes(dim)))))
    count = lambda e: F.when(F.col("whole"), F.greatest(F.floor(F.try_divide(e, F.col("size")) + 0.5).cast("int"), F.lit(1)))
    return rows.select("zone_id", "element_id", "k", "whole", "size", *(F.coalesce(count(e), F.lit(1)).alias(f"n_{a}") for e, a in zip(edges, axes(dim), strict=True)))


def refined(elements: DataFrame, nodes: DataFrame, dim: int, param: float, fields: tuple[str, ...] = ()) -> DataFrame:
    """A lattice of points over each element (``element_shapes``), with fields interpolated: size, i_*, t_*, axes, fields.

    Elements that are not whole give their nodes alone (i_* and t_* null).
    """
    names = [*axes(dim), *fields]
    rows = element_shapes(elements, nodes, dim, param, fields)
    index, local = [f"i_{a}" for a in axes(dim)], [f"t_{a}" for a in axes(dim)]
    for a in axes(dim):  # of an element that isn't whole, node after node along the first axis
        last = F.col(f"n_{a}") if a != "x" else F.when(F.col("whole"), F.col("n_x")).otherwise(F.size("k") - 1)
        last = last if a == "x" else F.when(F.col("whole"), last).otherwise(0)
        rows = rows.withColumn(f"i_{a}", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("*", *((F.col(f"i_{a}") / F.col(f"n_{a}")).alias(f"t_{a}") for a in axes(dim)))
    at = lambda i, n: F.get("k", F.lit(i))[n]
    value = lambda n: F.when(F.col("whole"), multilinear([F.col(t) for t in local], [at(i, n) for i in RING[dim]])).otherwise(F.get("k", F.col("i_x"))[n]).cast("double")
    there = [F.when(F.col("whole"), F.col(c)).alias(c) for c in [*index, *local]]
    return rows.select("zone_id", "element_id", "size", *there, *(value(n).alias(n) for n in names))


def multilinear(t: list[Column], corners: list[Column]) -> Column:
    """Interpolation over a box from its corner values in bit order (bit d of the corner: the side along axis d)."""
    out = None
    for c, v in enumerate(corners):
        w = reduce(lambda p, q: p * q, [x if c >> d & 1 else 1 - x for d, x in enumerate(t)])
        out = w * v if out is None else out + w * v
    return out


#: Node numbers of a quad or hexahedron (counter-clockwise rings) in bit order.
RING = {2: [0, 1, 3, 2], 3: [0, 1, 3, 2, 4, 5, 7, 6]}


def sub_faces(dim: int) -> list[tuple[int, ...]]:
    """Edges, faces and the volume of a hypercube as corner tuples, lower dimensions first."""
    found: list[tuple[int, ...]] = []
    for free in range(1, dim + 1):
        for mask in range(1 << dim):
            if bin(mask).count("1") != free:
                continue
            for base in range(1 << dim):
                if not base & mask:
                    found.append(tuple(c for c in range(1 << dim) if c & ~mask == base))
    return found


def _face_axes(dim: int) -> Column:
    """Per face of a quad or hexahedron, the element's axes along the face's first edge and the one that closes it."""
    name = "quad" if dim == 2 else "hexahedron"
    place = {node: bits for bits, node in enumerate(RING[dim])}
    axis = lambda a, b: (place[a] ^ place[b]).bit_length() - 1
    return F.array(*(F.array(F.lit(axis(f[0], f[1])), F.lit(axis(f[0], f[-1]))) for f in FACES[name]))


def boundary_points(bfaces: DataFrame, nodes: DataFrame, dim: int, intervals: int = 1, shapes: DataFrame | None = None) -> DataFrame:
    """Lattice points on boundary faces with the face's unit normal and a size.

    The size is the length of the face's first edge, and each way has ``intervals``. With ``shapes`` (of
    ``element_shapes``) both are the element's: its step over ``intervals``, and its intervals times ``intervals``.
    """
    rows = bfaces.select("zone_id", "element_id", "face", F.posexplode("nodes").alias("pos", "node_id")).join(nodes.select("zone_id", "node_id", *axes(dim)), ["zone_id", "node_id"])
    by = rows.groupBy("zone_id", "element_id", "face").agg(F.sort_array(F.collect_list(F.struct("pos", *axes(dim)))).alias("p"))
    at = lambda k, a: F.get("p", F.lit(k))[a]
    last = F.when(F.size("p") == 4, 3).otherwise(2) if dim == 3 else F.lit(1)
    if dim == 2:
        d = [at(1, a) - at(0, a) for a in axes(2)]
        normal = [d[1], -d[0]]
    else:
        u = [F.when(F.size("p") == 4, at(2, a) - at(0, a)).otherwise(at(1, a) - at(0, a)) for a in axes(3)]
        w = [F.when(F.size("p") == 4, at(3, a) - at(1, a)).otherwise(at(2, a) - at(0, a)) for a in axes(3)]
        normal = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    length = F.sqrt(reduce(lambda a, b: a + b, [n * n for n in normal]))
    edge = F.sqrt(reduce(lambda a, b: a + b, [(at(1, a) - at(0, a)) * (at(1, a) - at(0, a)) for a in axes(dim)]))
    if shapes is None:
        by = by.select("*", edge.alias("_size"), F.lit(intervals).alias("_u"), F.lit(intervals).alias("_w"))
    else:
        own = shapes.select("zone_id", "element_id", "whole", F.col("size").alias("_own"), F.array(*(f"n_{a}" for a in axes(dim))).alias("_n"))
        by = by.join(own, ["zone_id", "element_id"])
        ways = F.get(_face_axes(dim), F.col("face"))
        count = lambda k: F.when(F.col("whole"), F.get("_n", F.get(ways, F.lit(k)))).otherwise(1) * intervals
        by = by.select("zone_id", "element_id", "face", "p", (F.col("_own") / intervals).alias("_size"), count(0).alias("_u"), count(1).alias("_w"))
    rows = by.select("*", *(F.coalesce(F.try_divide(n, length), F.lit(0.0)).alias(f"n_{a}") for n, a in zip(normal, axes(dim), strict=True)), last.alias("_last"))
    rows = rows.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_u"))))
    t = F.col("_s") / F.col("_u")
    if dim == 3:
        rows = rows.withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_w"))))
        r = F.col("_r") / F.col("_w")
        corner = lambda a: [at(0, a), at(1, a), F.get("p", F.col("_last"))[a], at(2, a)]
        point = [multilinear([t, r], corner(a)) for a in axes(3)]
    else:
        point = [at(0, a) * (1 - t) + at(1, a) * t for a in axes(2)]
    return rows.select("zone_id", "element_id", "face", *(p.alias(a) for p, a in zip(point, axes(dim), strict=True)), *(f"n_{a}" for a in axes(dim)), F.col("_size").alias("size"))


def inflated(bounds_rows: DataFrame, points: DataFrame, dim: int, by: float = 1.0) -> DataFrame:
    """Bounds that also hold the boundary points moved outward by their size."""
    moved = points.select(*((F.col(a) + by * F.col("size") * F.col(f"n_{a}")).alias(a) for a in axes(dim)))
    more = moved.agg(*(f(a).alias(f"{n}_{a}") for a in axes(dim) for n, f in (("min", F.min), ("max", F.max))))
    return bounds_rows.unionByName(more).agg(*(f(f"{n}_{a}").alias(f"{n}_{a}") for a in axes(dim) for n, f in (("min", F.min), ("max", F.max))))

