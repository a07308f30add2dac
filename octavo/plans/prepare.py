"""Batch preparation: mesh, image and analytic problems to trees, subtrees and sparse fields; command-line parameters."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octavo.functions.cells import Cube, axes, bounds, cube_of, index_names, key_names, node_names
from octavo.operators import fields as ops
from octavo.operators import interpolate, mesh, tree
from octavo.sources import readers, writers
from octavo.storage import keep, scratch


@dataclass
class Parameters:
    """Parameters of a preparation, with their defaults."""

    mode: str = "mesh"
    mesh_file: str = ""
    output: str = ""
    dim: int = 3
    depth: int = 7
    max_full_level: int = 0
    max_level: int = 20
    refine: float = 1.0
    boundary_refine: int = 1
    boundary: bool = True
    #: frames that are prepared in one job
    threads: int = 1
    #: of an image: centre "i,j[,k]" and radius of the domain; of an analytic problem: its JSON file
    centre: str = ""
    radius: int = 0
    config: str = ""


MODES = ("mesh", "mesh_info", "meta_info", "image", "exact")


class Generator(Protocol):
    """A field generator, the engine's extension point: the prepared problem's subtrees and nodes to (key, depth, node, value)."""

    def __call__(self, made: Prepared, field: str, frame: int) -> DataFrame: ...


def generated(made: Prepared, generator: Generator, field: str, frame: int, dim: int) -> DataFrame:
    """A field of any generator, rolled up over the stored subtrees."""
    last = made.subtrees.agg(F.max("level")).first()[0]
    return ops.propagate(generator(made, field, frame), made.subtrees, dim, last)


#: Analytic point functions by name: Column functions of the coordinates and time.
FUNCTIONS: dict[str, Callable[..., Column]] = {"MultiscaleWaves": readers.waves}


def register(name: str, f: Callable[..., Column]) -> None:
    FUNCTIONS[name] = f


def transformed(voxels: DataFrame, array: str, f: Callable[[Column], Column]) -> DataFrame:
    """A voxel array through a function."""
    return voxels.withColumn(array, f(F.col(array)))


@dataclass
class ExactConfig:
    """An analytic problem: JSON keys with defaults, command line above both."""

    problemId: str = "MultiscaleWaves"  # noqa: N815
    outputDirectory: str = "."  # noqa: N815
    domain: dict = field(default_factory=lambda: {"min": {"x": 0.0, "y": 0.0, "z": 0.0}, "max": {"x": 1.0, "y": 1.0, "z": 1.0}})
    cell_count: dict = field(default_factory=lambda: {"x": 16, "y": 16, "z": 16})
    init_time: float = 0.0
    time_step: float = 1.0
    time_step_count: int = 1

    @staticmethod
    def merged(text: str, **overrides) -> ExactConfig:
        known = {f.name for f in fields(ExactConfig)}
        values = {k: v for k, v in json.loads(text).items() if k in known}
        return ExactConfig(**{**values, **overrides})


@dataclass
class Prepared:
    cube: Cube
    blocks: DataFrame
    subtrees: DataFrame
    sparse: DataFrame


def points_problem(points: DataFrame, dim: int, value: str, level: int, depth: int, full_level: int = 0) -> Prepared:
    """Scattered points with one field: blocks at one level, stored subtrees, weighted means, roll-up."""
    cube = cube_of(points, dim)
    blocks = keep(tree.with_ancestors(tree.occupied(points, cube, level), dim), "blocks")
    subtrees = keep(tree.storage_subtrees(blocks, dim, full_level, depth), "subtrees")
    # every block of the tree has a descendant at ``level``: there the points' cells are the deepest blocks
    cells = cube.cell([F.col(a) for a in axes(dim)], level)
    located = points.select(*axes(dim), value, F.lit(level).alias("level"), *(c.alias(n) for c, n in zip(cells, index_names(dim), strict=True)))
    own = keep(ops.subtree_mean(located, subtrees, cube, value).join(subtrees, key_names(dim)), "own")
    last = subtrees.agg(F.max("level")).first()[0]
    return Prepared(cube, blocks, subtrees, ops.propagate(own, subtrees, dim, last))


@dataclass
class PreparedMesh(Prepared):
    """``shape``: the boundary's field, if asked for; ``field_map``: the element to node incidence, for all frames."""

    corners: DataFrame
    shape: DataFrame | None
    field_map: DataFrame


def mesh_problem(elements: DataFrame, nodes: DataFrame, dim: int, depth: int, max_level: int, full_level: int = 0, refine: float = 1.0, boundary_refine: int = 1, boundary: bool = True) -> PreparedMesh:
    """A mesh: a tree by the size of its elements and around its boundary, stored subtrees, the boundary's shape, the field map.

    The bounds hold the boundary's points moved outward by their size. With ``refine`` below 1, elements count by the
    points and the step of their refinement, else by their nodes and largest edge. ``sparse`` is empty: fields are
    made by ``mesh_fields``, of any frame.
    """
    deepest = depth + max_level
    shapes = keep(mesh.element_shapes(elements, nodes, dim, refine), "shapes")
    faces = mesh.boundary_faces(elements)
    edge = keep(mesh.boundary_points(faces, nodes, dim, boundary_refine, shapes), "boundary")
    row = mesh.inflated(bounds(nodes, dim), edge, dim).first()
    cube = Cube.around([row[f"min_{a}"] for a in axes(dim)], [row[f"max_{a}"] for a in axes(dim)])
    if refine < 1:
        points = mesh.refined(elements, nodes, dim, refine).select(*axes(dim), "size")
    else:
        corner = mesh.element_nodes(elements, nodes.select("zone_id", "node_id", *axes(dim)))
        points = corner.join(mesh.element_boxes(elements, nodes, dim).select("zone_id", "element_id", "size"), ["zone_id", "element_id"]).select(*axes(dim), "size")
    blocks = tree.from_levels(points, cube, deepest, "size").unionByName(tree.around_boundary(edge, cube, deepest))
    blocks = keep(tree.filled(blocks, full_level, dim), "blocks")
    subtrees = keep(tree.storage_subtrees(blocks, dim, full_level, depth), "subtrees")
    corners = keep(tree.subtree_nodes(subtrees, blocks, dim), "corners")
    last = subtrees.agg(F.max("level")).first()[0]
    shape = None
    if boundary:
        # each subtree has its own scale, so nothing is rolled up
        shape = ops.boundary_field(edge, blocks, subtrees, cube, last + depth).join(subtrees, key_names(dim))
    field_map = keep(interpolate.subtree_map(elements, nodes, cube, subtrees, corners), "field_map")
    empty = corners.where("false").select(*key_names(dim), "depth", *node_names(dim), F.lit(0.0).alias("value"))
    return PreparedMesh(cube, blocks, subtrees, empty, corners, shape, field_map)


def mesh_fields(made: PreparedMesh, values: DataFrame, dim: int, by: tuple[str, ...] = ("field", "frame")) -> DataFrame:
    """Fields at the nodes of stored subtrees, rolled up: key, depth, node, value for each of ``by``. values: zone_id, node_id, by, v."""
    own = interpolate.apply_subtree_map(made.field_map, values.where("v is not null and not isnan(v)"), dim, by)
    own = keep(own.join(made.subtrees, key_names(dim)), "own")
    last = made.subtrees.agg(F.max("level")).first()[0]
    return ops.propagate(own, made.subtrees, dim, last, by)


def ranges(fields_: DataFrame, subtrees: DataFrame, by: tuple[str, ...] = ("field",)) -> DataFrame:
    """Each field's range over the leaves of the roll-up: all stored subtrees, every frame."""
    keys = [k for k in subtrees.columns if k != "depth"]
    return ops.merged_range(ops.field_range(fields_, [*by, "frame", *keys]), list(by))


def image_problem(voxels: DataFrame, dim: int, mask: Column, arrays: list[str], depth: int, max_level: int, sizes: list[int]) -> Prepared:
    """Voxels of a domain: tree at the image's depth or the allowed one; fields by weighted means of voxel centres, rolled up.

    Fields: shape (1 in the domain, -1 outside), the arrays (known in the domain), and the coordinates.
    """
    from octavo.functions.cells import image_block, sufficient_depth

    full = sufficient_depth(sizes)
    level = min(full, max_level)
    kept = ops.stencil(voxels, mask)
    cells = image_block([F.col(n) for n in index_names(dim)], full, level)
    cube = Cube((0.0,) * dim, float(1 << full))
    blocks = keep(tree.with_ancestors(kept.select(F.lit(level).alias("level"), *(c.cast("int").alias(n) for c, n in zip(cells, index_names(dim), strict=True))), dim), "blocks")
    subtrees = keep(tree.storage_subtrees(blocks, dim, 0, depth), "subtrees")
    # every point with each of its fields; the shape is known outside of the domain too
    values = [F.struct(F.lit("shape").alias("field"), F.when(mask, 1.0).otherwise(-1.0).alias("v"))]
    values += [F.struct(F.lit(n).alias("field"), F.when(mask, F.col(n)).cast("double").alias("v")) for n in arrays]
    points = ops.image_points(voxels, dim).withColumn("_f", F.explode(F.array(*values))).select(*axes(dim), "_f.field", "_f.v").where("v is not null")
    located = tree.deepest_block(points, blocks, cube, level)
    own = ops.subtree_mean(located, subtrees, cube, "v", ("field",)).join(subtrees, key_names(dim))
    # the position itself, as one field for each axis
    corners = tree.subtree_nodes(subtrees, blocks, dim)
    places = [F.struct(F.lit(f"coord_{a}").alias("field"), p.alias("value")) for a, p in zip(axes(dim), node_places(cube), strict=True)]
    places = corners.withColumn("_f", F.explode(F.array(*places))).select("_f.field", *key_names(dim), "depth", *node_names(dim), "_f.value")
    own = keep(own.select(*places.columns).unionByName(places), "own")
    last = subtrees.agg(F.max("level")).first()[0]
    return Prepared(cube, blocks, subtrees, ops.propagate(own, subtrees, dim, last, ("field",)))


def node_places(cube: Cube) -> list[Column]:
    """The position of a subtree's node, from its key, depth and node."""
    step = cube.block_size(F.col("level")) / F.pow(F.lit(2.0), F.col("depth"))
    return [m + F.col(n) * step for m, n in zip(cube.block_min(F.col("level"), [F.col(i) for i in index_names(cube.dim)]), node_names(cube.dim), strict=True)]


def exact_problem(spark: SparkSession, config: ExactConfig, dim: int = 3, depth: int = 3, max_depth: int = 6) -> Prepared:
    """An analytic function on a full tree, for every time step: one column ``frame`` instead of a task for each."""
    mins = tuple(float(config.domain["min"][a]) for a in axes(dim))
    maxs = tuple(float(config.domain["max"][a]) for a in axes(dim))
    cube = Cube.around(list(mins), list(maxs))
    cell = min((b - a) / config.cell_count[x] for a, b, x in zip(mins, maxs, axes(dim), strict=True))
    blocks = tree.full_tree(spark, tree.exact_depth(cube.size, cell, max_depth), dim)
    subtrees = tree.storage_subtrees(blocks, dim, 0, depth)
    nodes = tree.subtree_nodes(subtrees, blocks, dim)
    nodes = nodes.select("*", *(p.alias(a) for p, a in zip(node_places(cube), axes(dim), strict=True)))
    nodes = readers.with_times(nodes, [config.init_time + k * config.time_step for k in range(config.time_step_count)])
    v = FUNCTIONS[config.problemId](*(F.col(a) for a in axes(dim)), F.col("time"))
    sparse = nodes.select(*key_names(dim), "depth", *node_names(dim), F.when(~F.isnan(v), v).alias("value"), "frame")
    return Prepared(cube, blocks, subtrees, sparse)


def run(spark: SparkSession, p: Parameters) -> DataFrame:
    """A command-line mode's result."""
    if p.mode == "mesh_info":
        zones = readers.read_mesh(spark, p.mesh_file, "zones")
        return mesh.mesh_info(zones.select(F.col("zone_id").cast("string").alias("zone"), "etype", "elements", "nodes"))
    if p.mode == "meta_info":
        subtrees, _ = writers.read_metadata(spark, p.output, p.dim)
        return tree.levels(subtrees)
    if p.mode == "mesh":
        return _mesh_mode(spark, p)
    if p.mode == "image":
        return _image_mode(spark, p)
    if p.mode == "exact":
        return _exact_mode(spark, p)
    raise ValueError(f"mode {p.mode!r}: one of {', '.join(MODES)}")


def _write(made: Prepared, p: Parameters, dim: int) -> None:
    writers.write_metadata(made.subtrees, p.output, p.max_full_level, p.depth, dim)


def _catalogue(spark: SparkSession, p: Parameters, found: DataFrame, frames: int, shape: bool) -> None:
    """The field catalogue beside the fields: one line for each field."""
    rows = [(r.field, r.min, r.max, frames > 1) for r in found.orderBy("field").collect()]
    spark.createDataFrame([(writers.field_info(frames, rows, shape),)], "value string").coalesce(1).write.mode("overwrite").text(f"{p.output}/fields_info")


def _mesh_mode(spark: SparkSession, p: Parameters) -> DataFrame:
    """All fields of all frames of a mesh: tree and field map from frame 0, values of every frame through the same map."""
    from octavo.sources.formats import layout, roles

    at = lambda path: writers.exists(spark, path)
    first, many = readers.first_frame(p.mesh_file, at, at)
    coordinates, names = roles(layout(first).variables)
    dim = len(coordinates)
    rename = dict(zip(coordinates, axes(dim), strict=True))
    nodes = keep(readers.read_mesh(spark, first, variables=coordinates).withColumnsRenamed(rename), "nodes")
    elements = keep(readers.read_mesh(spark, first, "elements"), "elements")
    made = mesh_problem(elements, nodes, dim, p.depth, p.max_level, p.max_full_level, p.refine, p.boundary_refine, p.boundary)
    _write(made, p, dim)
    interpolate.write_field_map(made.field_map, f"{p.output}/field_map")
    if made.shape is not None:
        writers.write_field(made.shape, f"{p.output}/fields", "shape", 0, dim)
    paths = [first]
    while many and at(readers.frame_file(p.mesh_file, len(paths))):
        paths.append(readers.frame_file(p.mesh_file, len(paths)))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("double").alias("v")) for n in names)))
    found = None
    for begin in range(0, len(paths), max(1, p.threads)):
        batch = range(begin, min(len(paths), begin + max(1, p.threads)))
        rows = [readers.read_mesh(spark, paths[i], variables=names).select("zone_id", "node_id", F.lit(i).alias("frame"), each.alias("_f")) for i in batch]
        values = reduce(DataFrame.unionByName, rows).select("zone_id", "node_id", "_f.field", "frame", "_f.v")
        with scratch(spark):
            sparse = keep(mesh_fields(made, values, dim), "fields")
            for i in batch:
                for name in names:
                    writers.write_field(sparse.where((F.col("frame") == i) & (F.col("field") == name)).drop("field", "frame"), f"{p.output}/fields", name, i, dim)
            here = keep(ranges(sparse, made.subtrees), "ranges", outer=True)
        found = here if found is None else found.unionByName(here)
    frame = len(paths)
    _catalogue(spark, p, ops.merged_range(found, ["field"]), frame, made.shape is not None)
    return made.subtrees


def _image_mode(spark: SparkSession, p: Parameters) -> DataFrame:
    """All arrays of a voxel image; the domain is a ball of voxels, or all of them."""
    from octavo.sources.formats import read_rect_grid

    voxels = keep(readers.read_voxels(spark, p.mesh_file, p.dim), "voxels")
    arrays = [c for c in voxels.columns if c not in index_names(p.dim)]
    mask = ops.sphere_mask(p.dim, tuple(int(x) for x in p.centre.split(",")), p.radius) if p.centre else F.lit(True)
    made = image_problem(voxels, p.dim, mask, arrays, p.depth, p.depth + p.max_level, list(read_rect_grid(p.mesh_file, p.dim, only=[]).cells))
    _write(made, p, p.dim)
    sparse = keep(made.sparse.withColumn("frame", F.lit(0)), "fields")
    for name in ["shape", *arrays, *(f"coord_{a}" for a in axes(p.dim))]:
        writers.write_field(sparse.where(F.col("field") == name).drop("field", "frame"), f"{p.output}/fields", name, 0, p.dim)
    _catalogue(spark, p, ranges(sparse, made.subtrees).where("field <> 'shape'"), 1, True)
    return made.subtrees


def _exact_mode(spark: SparkSession, p: Parameters) -> DataFrame:
    """An analytic problem of a JSON file, every time step."""
    text = "\n".join(r.value for r in spark.read.text(p.config).collect()) if p.config else "{}"  # a few lines
    config = ExactConfig.merged(text, **({"outputDirectory": p.output} if p.output else {}))
    made = exact_problem(spark, config, p.dim, p.depth, p.depth + p.max_level)
    at = replace(p, output=config.outputDirectory)
    _write(made, at, p.dim)
    sparse = keep(made.sparse.withColumn("field", F.lit(config.problemId)), "fields")
    for frame in range(config.time_step_count):
        writers.write_field(sparse.where(F.col("frame") == frame).drop("field", "frame"), f"{at.output}/fields", config.problemId, frame, p.dim)
    _catalogue(spark, at, ranges(sparse, made.subtrees), config.time_step_count, False)
    return made.subtrees


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="octavo")
    for f in fields(Parameters):
        kind = type(f.default)
        parser.add_argument(f"--{f.name}", default=f.default, type=(lambda s: s in ("1", "true", "on")) if kind is bool else kind)
    spark = SparkSession.builder.getOrCreate()
    run(spark, Parameters(**vars(parser.parse_args(args)))).show(1000, truncate=False)
