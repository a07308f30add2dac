"""Sinks: tables as Parquet by field, frame and level; text and binary exports; logs; timelines and graphs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octavo.functions.cells import axes, index_names
from octavo.sources import formats
from octavo.storage import remove

FORMAT_VERSION = 1


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_metadata(subtrees: DataFrame, path: str, full_level: int, depth: int, dim: int) -> None:
    """Stored subtrees by level, and a sidecar with the format's version and parameters."""
    subtrees.write.mode("overwrite").partitionBy("level").parquet(f"{path}/subtrees")
    side = subtrees.sparkSession.createDataFrame([(json.dumps({"format_version": FORMAT_VERSION, "max_full_level": full_level, "depth": depth, "dim": dim}),)], "value string")
    side.coalesce(1).write.mode("overwrite").text(f"{path}/info")


def read_metadata(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, dict]:
    """Subtrees and parameters. Without a sidecar it is version 0: no full level, depth the largest stored one."""
    subtrees = spark.read.parquet(f"{path}/subtrees")
    if exists(spark, f"{path}/info"):
        info = json.loads(spark.read.text(f"{path}/info").first()[0])
    else:
        info = {"format_version": 0, "max_full_level": 0, "depth": subtrees.agg(F.max("depth")).first()[0], "dim": dim}
    if info["format_version"] > FORMAT_VERSION or info["dim"] != dim:
        raise formats.FormatError("the metadata's version or dimension does not fit")
    return subtrees, info


def write_field(values: DataFrame, path: str, field: str, frame: int, dim: int) -> bool:
    """One field of one frame, in order of subtree for row-group pruning; left alone if it is there already."""
    at = f"{path}/field={field}/frame={frame}"
    if exists(values.sparkSession, f"{at}/_SUCCESS"):
        return False
    # what a failed write has left behind is written anew
    values.repartitionByRange("level", *index_names(dim)).sortWithinPartitions("level", *index_names(dim)).write.mode("overwrite").parquet(at)
    return True


def read_field(spark: SparkSession, path: str, field: str | None = None, frame: int | None = None) -> DataFrame:
    """Sparse fields; field and frame prune directories, levels and indices row groups."""
    rows = spark.read.parquet(path)
    rows = rows if field is None else rows.where(F.col("field") == field)
    return rows if frame is None else rows.where(F.col("frame") == frame)


def write_tsv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def text_mesh(variables: list[str], zones: Iterable[tuple[list[int], np.ndarray]], digits: int = 10) -> Iterable[str]:
    """Lines of a text mesh of ordered zones."""
    yield "variables = " + ", ".join(f'"{v}"' for v in variables)
    for shape, rows in zones:
        yield "zone " + " ".join(f"{a}={n}" for a, n in zip("ijk", shape, strict=False))
        for row in rows:
            yield "\t".join(f"{x:.{digits}g}" for x in row)


def mesh_text(nodes: DataFrame, variables: list[str], path: str) -> None:
    """Node rows of each zone as tab-separated text, a directory for each zone; order is by node."""
    line = F.concat_ws("\t", *(F.format_string("%.10g", v) for v in variables))
    rows = nodes.repartitionByRange("zone_id", "node_id").sortWithinPartitions("zone_id", "node_id")
    rows.select("zone_id", line.alias("value")).write.mode("overwrite").partitionBy("zone_id").text(path)


def convert_mesh(spark: SparkSession, source: str, target: str) -> None:
    """A mesh file to Parquet: nodes and zones, partitioned by zone."""
    from octavo.sources.readers import read_mesh

    read_mesh(spark, source).write.mode("overwrite").partitionBy("zone_id").parquet(f"{target}/nodes")
    read_mesh(spark, source, "zones").write.mode("overwrite").parquet(f"{target}/zones")


def boundary_text(faces: DataFrame, nodes: DataFrame, dim: int, path: str) -> None:
    """Boundary faces with their corners' positions, by zone."""
    corners = faces.select("zone_id", "element_id", "face", F.posexplode("nodes").alias("pos", "node_id")).join(nodes, ["zone_id", "node_id"])
    line = F.concat_ws("\t", "element_id", "face", "pos", *(F.format_string("%.10g", a) for a in axes(dim)))
    corners.repartitionByRange("zone_id", "element_id", "face", "pos").sortWithinPartitions("zone_id", "element_id", "face", "pos").select("zone_id", line.alias("value")).write.mode("overwrite").partitionBy("zone_id").text(path)


def by_subtype(elements: DataFrame, path: str) -> None:
    """Sections of one element subtype each (triangles, quads, tetrahedra, pyramids, prisms, hexahedra)."""
    from octavo.operators.mesh import with_subtype

    with_subtype(elements).write.mode("overwrite").partitionBy("subtype").parquet(path)


def field_info(steps: int, fields: list[tuple[str, float | None, float | None, bool]], boundary: bool = False) -> str:
    """The field catalogue's text; an empty range is ``-``. With a boundary it lists the shape field too."""
    rows = [*([("shape", -1.0, 1.0, False)] if boundary else []), *fields]
    show = lambda v: "-" if v is None else f"{v:.10g}"
    lines = [f"time_steps\t{steps}", str(len(rows)), "", "name\tmin\tmax\tanimated"]
    for name, lo, hi, animated in rows:
        empty = lo is None or hi is None or lo > hi
        lines.append("\t".join([name, show(None if empty else lo), show(None if empty else hi), str(int(animated))]))
    return "\n".join(lines) + "\n"


def bounds_text(mins: list[float], maxs: list[float]) -> str:
    return "\n".join("\t".join(f"{x:.17g}" for x in row) for row in (mins, maxs)) + "\n"


def read_bounds(text: str) -> tuple[list[float], list[float]]:
    a, b = ([float(x) for x in line.split()] for line in text.strip().split("\n"))
    return a, b


def swap_in(df: DataFrame, path: str) -> None:
    """A frame's pixels replaced at once: each is written whole beside the others, and a reader takes the newest that is whole.

    Nothing that a reader may have begun on is changed; what is older than the one before goes.
    """
    spark = df.sparkSession
    found = _whole(spark, path)
    df.write.parquet(f"{path}/v{found[-1] + 1 if found else 0:012d}")
    for old in found[:-1]:
        remove(spark, f"{path}/v{old:012d}")


def _whole(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a frame's versions that are written to the end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(p):
        return []
    names = [f.getPath().getName() for f in system.listStatus(p)]
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d{12}", n) and exists(spark, f"{path}/{n}/_SUCCESS"))


def read_swapped(spark: SparkSession, path: str) -> DataFrame:
    """The frame that was put in place last."""
    found = _whole(spark, path)
    if not found:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{found[-1]:012d}")


def telemetry_lines(rows: DataFrame) -> DataFrame:
    """Timing rows as log lines in order of frame and line, with ``-`` after each frame."""
    body = F.concat_ws("\t", *(c for c in rows.columns if c not in ("frame", "line")))
    lines = rows.select("frame", "line", F.lit(0).alias("end"), body.alias("value"))
    ends = rows.groupBy("frame").agg(F.max("line").alias("line")).select("frame", "line", F.lit(1).alias("end"), F.lit("-").alias("value"))
    return lines.unionByName(ends).orderBy("frame", "line", "end").select("value")


def key_values(values: dict) -> str:
    return "".join(f"{k}={v}\n" for k, v in values.items())


def request_log(requests: DataFrame) -> DataFrame:
    """``timeSinceEpoch; userId; request`` lines."""
    return requests.select(F.concat_ws("; ", "time", "user", "request").alias("value"))


def parse_request_log(lines: DataFrame) -> DataFrame:
    p = r"^(\d+); ([^;]*); (.*)$"
    return lines.select(F.regexp_extract("value", p, 1).cast("long").alias("time"), F.regexp_extract("value", p, 2).alias("user"), F.regexp_extract("value", p, 3).alias("request"))


def client_times(rows: DataFrame) -> DataFrame:
    """Shared frame, level, duration and client frame as text lines."""
    return rows.select(F.concat_ws(" ", "frame", "level", "duration", "client_frame").alias("value"))


def graph_dot(edges: DataFrame) -> str:
    """A task graph as DOT text; graphs of tasks are small."""
    return "digraph {\n" + "".join(f'  "{a}" -> "{b}";\n' for a, b in sorted(map(tuple, edges.select("from", "to").distinct().toLocalIterator()))) + "}\n"
