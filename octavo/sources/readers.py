"""Scans: mesh files as a Spark data source, voxel grids, telemetry, catalogues, generators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from octavo.functions.cells import axes, index_names
from octavo.operators.mesh import odometer
from octavo.sources import formats

#: Rows of a partition of a mesh scan.
ROWS = 1 << 20


class _Part(InputPartition):
    def __init__(self, file: formats.Layout, zone: int, first: int, rows: int):
        self.file, self.zone, self.first, self.rows = file, zone, first, rows


class MeshReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "nodes")
        self.names = [n for n in options.get("variables", "").split(",") if n]
        self.rows = int(options.get("rows", ROWS))

    def partitions(self) -> list[_Part]:
        """The file is looked through once, here; each part knows where its rows begin."""
        file = formats.layout(self.path)
        if self.table == "zones":
            return [_Part(file.part(0, 0, 0) if file.zones else file, 0, 0, len(file.zones))]
        counts = [z.nodes if self.table == "nodes" else z.elements for z in file.zones]
        return [_Part(file.part(i, at, min(self.rows, n - at)), i, at, min(self.rows, n - at)) for i, n in enumerate(counts) for at in range(0, n, self.rows)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        file = part.file
        if self.table == "zones":
            z = file.zones
            yield pa.RecordBatch.from_pydict({"zone_id": pa.array(range(len(z)), pa.int32()), "title": [x.title for x in z], "etype": [x.etype for x in z], "nodes": [x.nodes for x in z], "elements": [x.elements for x in z], "shape": pa.array([x.shape for x in z], pa.list_(pa.int64()))})
            return
        ids = pa.array(np.arange(part.first, part.first + part.rows))
        zone = pa.array(np.full(part.rows, part.zone, np.int32))
        if self.table == "elements":
            n = file.read_elements(part.zone, part.first, part.rows)
            flat = pa.array(n.ravel(), mask=n.ravel() < 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.rows + 1, dtype=np.int32) * n.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([zone, ids, pa.array([file.zones[part.zone].etype] * part.rows), lists], ["zone_id", "element_id", "etype", "nodes"])
            return
        values = file.read_nodes(part.zone, part.first, part.rows)
        names = self.names or file.variables
        yield pa.RecordBatch.from_arrays([zone, ids, *(pa.array(values[:, file.variables.index(n)]) for n in names)], ["zone_id", "node_id", *names])


class MeshSource(DataSource):
    """``spark.read.format("mesh").option("path", ...).option("table", "nodes" | "elements" | "zones")``; ``variables`` projects."""

    @classmethod
    def name(cls) -> str:
        return "mesh"

    def schema(self) -> str:
        table = self.options.get("table", "nodes")
        if table == "zones":
            return "zone_id int, title string, etype string, nodes bigint, elements bigint, shape array<bigint>"
        if table == "elements":
            return "zone_id int, element_id bigint, etype string, nodes array<bigint>"
        names = [n for n in self.options.get("variables", "").split(",") if n] or formats.layout(self.options["path"]).variables
        return "zone_id int, node_id bigint, " + ", ".join(f"`{n}` double" for n in names)

    def reader(self, schema) -> MeshReader:
        return MeshReader(dict(self.options))


def read_mesh(spark: SparkSession, path: str, table: str = "nodes", variables: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """A mesh file's nodes (only the variables named, if any), elements or zones, one partition for each range of rows."""
    spark.dataSource.register(MeshSource)
    return spark.read.format("mesh").option("path", path).option("table", table).option("variables", ",".join(variables or [])).option("rows", rows).load()


def zone_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("zone_id").agg(F.count("*").alias("nodes"))


def read_voxels(spark: SparkSession, path: str, dim: int, arrays: list[str] | None = None, slab: int = 1 << 20) -> DataFrame:
    """A rectangular grid's cells with their arrays; ranges of cells are read by the workers."""
    grid, found = formats.rect_grid_header(path, dim)
    cells = grid.cells
    total = int(np.prod(cells))
    kinds = {"f": "double", "i": "bigint", "u": "bigint", "b": "bigint"}
    named = {n: a for n, a in found.items() if a[1] == total and (arrays is None or n in arrays)}
    columns = {n: kinds[np.dtype(a[0]).kind] for n, a in named.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in batch.column(0).to_pylist():
                at = np.arange(begin, min(total, begin + slab))
                made, o = [], at
                for n in cells:
                    made.append(pa.array((o % n).astype(np.int32)))
                    o = o // n
                made += [pa.array(formats.read_cells(path, a, begin, len(at)).astype(float if columns[n] == "double" else np.int64)) for n, a in named.items()]
                yield pa.RecordBatch.from_arrays(made, [*index_names(dim), *columns])

    schema = ", ".join([*(f"{i} int" for i in index_names(dim)), *(f"`{n}` {t}" for n, t in columns.items())])
    parts = max(1, -(-total // slab))
    return spark.range(0, total, slab, parts).mapInArrow(run, schema)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Timing log: tab-separated rows, ``-`` ends a frame, blank lines are skipped.

    Columns: line, frame, node, thread, level, start, after_clear, after_sort, blocks (index and times of each), end times.
    The frame is the number of ``-`` lines before; text files are read by offset, so lines keep their order.
    """
    from octavo.functions.prefix import sum_before

    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    ends = F.when(F.trim("value") == "-", 1).otherwise(0).cast("long")
    rows = sum_before(lines, [], F.floor(F.col("line") / 100_000), [F.col("line")], ends, "frame").where(F.trim("value") != "-")
    p = F.split("value", "\t")
    number = lambda i: F.element_at(p, i).cast("double")
    n = F.element_at(p, 7).cast("int")
    # a block: b, ix iy iz, p and three times, s and three times, before and after rendering
    width = 14
    block = lambda k: F.struct(*(F.element_at(p, (F.lit(8) + k * width + 1 + d).cast("int")).cast("int").alias(a) for d, a in enumerate(("ix", "iy", "iz"))), F.transform(F.array(*(F.lit(x) for x in (5, 6, 7, 9, 10, 11, 12, 13))), lambda o: F.element_at(p, (F.lit(8) + k * width + o).cast("int")).cast("double")).alias("times"))
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), block)).otherwise(F.array().cast("array<struct<ix:int,iy:int,iz:int,times:array<double>>>"))
    tail = lambda i: F.element_at(p, (F.lit(8) + n * width + 1 + i).cast("int")).cast("double")
    return rows.select("line", F.col("frame").cast("int").alias("frame"), *(F.element_at(p, i + 1).cast("int").alias(c) for i, c in enumerate(("node", "thread", "level"))), number(4).alias("start"), number(5).alias("after_clear"), number(6).alias("after_sort"), blocks.alias("blocks"), *(tail(i).alias(c) for i, c in enumerate(("after_copy", "after_crop", "after_store"))))


def read_field_info(text: str) -> tuple[int, list[tuple[str, float | None, float | None, bool]]]:
    """The field catalogue: time steps, then (name, min, max, animated); ``-`` is no value. Errors name the line."""
    lines = text.split("\n")

    def at(i: int) -> str:
        if i >= len(lines):
            raise formats.FormatError(f"line {i + 1}: the file ends")
        return lines[i].strip()

    m = re.fullmatch(r"time_steps\s+(\d+)", at(0))
    if not m or not at(1).isdigit():
        raise formats.FormatError("line 1 or 2: time steps and the number of fields")
    out = []
    for i in range(int(at(1))):
        parts = at(4 + i).split()
        if len(parts) != 4:
            raise formats.FormatError(f"line {5 + i}: name, min, max, animated")
        lo, hi = (None if p == "-" else float(p) for p in parts[1:3])
        out.append((parts[0], lo, hi, parts[3] == "1"))
    return int(m[1]), out


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of problems: name and path."""
    return spark.read.json(path, multiLine=True, schema="problems array<struct<name:string,path:string>>").select(F.explode("problems").alias("p")).select("p.name", "p.path")


def frame_file(path: str, frame: int) -> str:
    """The file of a time step: ``stem/stem_tNNNNNN.ext``."""
    base, dot, ext = path.rpartition(".")
    stem = base.rpartition("/")[2]
    return f"{base}/{stem}_t{frame:06d}{dot}{ext}"


def first_frame(path: str, is_file, is_dir) -> tuple[str, bool]:
    """(path of the first frame, whether there are time steps); tests of existence are passed in."""
    if is_file(path):
        return path, False
    if is_dir(path.rpartition(".")[0]):
        return frame_file(path, 0), True
    raise FileNotFoundError(path)


def times(first: float, second: float, count: int) -> list[float]:
    return [first + (k * (second - first) / (count - 1) if k else 0.0) for k in range(count)]


# -- generators --------------------------------------------------------------


def _lerp(a: float, b: float, i: Column, n: int) -> Column:
    return F.lit(a) + (b - a) * i / max(1, n - 1)


def _written(rows: DataFrame, at: list[Column], scale: tuple[float, ...], value: Column, more: Column, name: str) -> DataFrame:
    """Node table of a generated zone: scaled places, F and one more field."""
    placed = (p * float(k) for p, k in zip(at, scale, strict=False))
    return rows.select(F.lit(0).alias("zone_id"), F.col("id").alias("node_id"), *(p.alias(x) for p, x in zip(placed, axes(len(at)), strict=True)), value.cast("double").alias("F"), more.cast("double").alias(name))


def sphere_counts(dim: int, nodes: float, r1: float = 0.1, r2: float = 1.0, theta: tuple[float, float] = (10.0, 170.0), phi: tuple[float, float] = (0.0, 270.0)) -> list[int]:
    """Nodes along the radius (and nutation) and azimuth for about ``nodes`` in all; 2 ** dim nodes make one element."""
    if dim == 1:
        return [int(nodes + 0.5)]
    thick, wide, high = 2 * (r2 - r1) / (r2 + r1), np.deg2rad(phi[1] - phi[0]), np.deg2rad(theta[1] - theta[0])
    if abs(nodes - 2**dim) < 0.1:
        return [2] * dim
    arcs = [wide] if dim == 2 else [high, wide]
    radial = int((thick ** (dim - 1) * nodes / float(np.prod(arcs))) ** (1 / dim) + 0.5)
    return [radial, *(int(x * radial / thick + 0.5) for x in arcs)]


def sphere(spark: SparkSession, dim: int, nodes: float = 1000.0, r1: float = 0.1, r2: float = 1.0, theta: tuple[float, float] = (10.0, 170.0), phi: tuple[float, float] = (0.0, 270.0), scale: tuple[float, float, float] = (1.0, 1.0, 1.0), time: float = 0.0) -> DataFrame:
    """Nodes of a part of a spherical shell, radii graded towards r1, with the fields F and xx (x before scaling).

    dim 1 is a radius, 2 a ring sector in azimuth, 3 a shell sector in nutation and azimuth (degrees). The
    radius runs fastest, then the nutation.
    """
    counts = sphere_counts(dim, nodes, r1, r2, theta, phi)
    steps = ["i", "j", "k"][:dim]
    rows = odometer(spark, counts, steps)
    grade = (r2 - r1) ** 2 / (r2 + r1)
    t = _lerp(0, 1, F.col("i"), counts[0])
    rows = rows.withColumn("r", F.lit(r1) + t * (F.lit(2 * r1 * (r2 - r1) / (r1 + r2)) + t * grade))
    turn = lambda span, name, n: _lerp(*(float(np.deg2rad(x)) for x in span), F.col(name), n)
    wave = lambda periods, name, n: F.sin((1 + time) * _lerp(0.0, 2 * periods * np.pi, F.col(name), n))
    value = F.sin(F.lit(2 * np.pi) / (5 * F.col("r") * (1 + time)))
    if dim == 1:
        at = [F.col("r")]
    elif dim == 2:
        azimuth = turn(phi, "j", counts[1])
        at = [F.col("r") * F.cos(azimuth), F.col("r") * F.sin(azimuth)]
        value = value * wave(8, "j", counts[1])
    else:
        nutation, azimuth = turn(theta, "j", counts[1]), turn(phi, "k", counts[2])
        at = [F.col("r") * F.sin(nutation) * F.cos(azimuth), F.col("r") * F.sin(nutation) * F.sin(azimuth), F.col("r") * F.cos(nutation)]
        value = value * wave(4, "j", counts[1]) * wave(8, "k", counts[2])
    return _written(rows, at, scale, value, at[0], "xx")


def graded(i: Column, intervals: int, ratio: float, start: float, length: float) -> Column:
    """Place of node i of a stretch whose steps grow geometrically, the last ``ratio`` times the first."""
    q = ratio ** (1 / max(1, intervals - 1))
    if q == 1:
        return F.lit(float(start)) + length * i / max(1, intervals)
    return F.lit(float(start)) + length * (1 - F.pow(F.lit(q), i)) / (1 - q**intervals)


def cube(spark: SparkSession, dim: int, nodes: float = 1000.0, half: float = 1.0, ratios: tuple[float, float, float] = (1.0, 1.0, 1.0), scale: tuple[float, float, float] = (1.0, 1.0, 1.0), time: float = 0.0) -> DataFrame:
    """Nodes of the cube [-half, half] ** dim (in one dimension, of [0, 1]) graded by ``ratios``, with F and lin = x + 2 y + 3 z.

    x runs fastest. In one dimension the second field is called xx, and is x; in three, z is not scaled.
    """
    n = int(nodes ** (1 / dim) + 0.5)
    steps = ["i", "j", "k"][:dim]
    rows = odometer(spark, [n] * dim, steps)
    start, length = (0.0, 1.0) if dim == 1 else (-half, 2 * half)
    names = axes(dim)
    rows = rows.select("id", *(graded(F.col(i), n - 1, f, start, length).cast("double").alias(a) for i, a, f in zip(steps, names, ratios, strict=False)))
    at = [F.col(a) for a in names]
    near = 1e-5 * half
    flat = F.sqrt(at[0] * at[0] + at[1] * at[1]) if dim > 1 else None
    r = at[0] if dim == 1 else flat if dim == 2 else F.sqrt(at[0] * at[0] + at[1] * at[1] + at[2] * at[2])
    value = F.sin(F.lit(2 * np.pi) / (5 * F.greatest(r * (1 + time), F.lit(1e-10))))
    if dim > 1:
        azimuth = F.when(F.abs(at[0]) + F.abs(at[1]) < near, 0.0).otherwise(F.atan2(at[1], at[0]))
        value = value * F.sin((1 + time) * 8 * azimuth)
    if dim > 2:
        nutation = F.when(flat + F.abs(at[2]) < near, 0.0).otherwise(F.atan2(flat, at[2]))
        value = value * F.sin((1 + time) * 8 * nutation)
    linear = at[0] if dim == 1 else at[0] + 2 * at[1] if dim == 2 else at[0] + 2 * at[1] + 3 * at[2]
    return _written(rows, at, scale if dim < 3 else (scale[0], scale[1], 1.0), value, linear, "xx" if dim == 1 else "lin")


def waves(x: Column, y: Column, z: Column, t: float | Column) -> Column:
    """Multiscale waves: sin(pi X / z) sin(pi Y / z) sin(1 / z + pi t) - z, with X = c x + s y and Y = c y - s x of the angle pi z / 2."""
    s, c = F.sin(F.lit(np.pi / 2) * z), F.cos(F.lit(np.pi / 2) * z)
    return F.sin(F.lit(np.pi) * (c * x + s * y) / z) * F.sin(F.lit(np.pi) * (c * y - s * x) / z) * F.sin(1 / z + np.pi * t) - z


def with_times(nodes: DataFrame, steps: list[float]) -> DataFrame:
    """Each node at each frame; the frames are a short list."""
    return nodes.withColumn("_t", F.explode(F.array(*(F.struct(F.lit(i).alias("frame"), F.lit(float(t)).alias("time")) for i, t in enumerate(steps))))).select("*", "_t.frame", "_t.time").drop("_t")
