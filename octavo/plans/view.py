"""View queries: the state of a view, the parameter tree, the field service, and the plan of a frame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octavo.functions.cells import index_names, node_names
from octavo.operators import dense
from octavo.storage import keep, sized

MODES = ("Isosurface", "Isosurfaces", "MIP", "ARGB", "ARGBLight", "DomainVoxels", "ValueOnIsosurface", "ValueOnIsosurfaces")


@dataclass(frozen=True)
class ViewQuery:
    """What a view shows. Mode parameters are a tree of their own."""

    problem: str = ""
    frame: int = 0
    primary: str = ""
    secondary: str = ""
    mode: str = "MIP"
    level: int = -1
    index_box: tuple[tuple[int, ...], tuple[int, ...]] | None = None
    planes: tuple = ()
    viewport: tuple[int, int] = (1024, 768)
    fov: float = 45.0
    quality: float = 0.5
    background: tuple[int, int, int] = (0, 0, 0)
    frame_interval_ms: int = 40
    parameters: dict[str, Any] = field(default_factory=dict)


class ParameterTree:
    """Get, set and list values by a dotted path. Scalars keep their type, arrays are replaced, objects too if plain."""

    def __init__(self, root: dict):
        self.root = root

    def _at(self, path: str):
        node = self.root
        for part in filter(None, path.split(".")):
            if not isinstance(node, dict) or part not in node:
                raise KeyError(path)
            node = node[part]
        return node

    def get(self, path: str = ""):
        return self._at(path)

    def names(self, path: str = "") -> list[str]:
        node = self._at(path)
        if not isinstance(node, dict):
            raise TypeError(f"{path} has no names")
        return list(node)

    def set(self, path: str, value) -> None:
        parent, _, name = path.rpartition(".")
        node, old = self._at(parent), self._at(path)
        number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
        same = type(old) is type(value) or number(old) and number(value)
        if not same:
            raise TypeError(f"{path} has another type")
        node[name] = value


def changed(query: ViewQuery, **values) -> ViewQuery:
    """The query with new values; names and types are checked."""
    for k, v in values.items():
        old = getattr(query, k)
        if old is not None and v is not None and type(old) is not type(v) and not (isinstance(old, float) and isinstance(v, int)):
            raise TypeError(f"{k} has another type")
    return replace(query, **values)


class FieldService:
    """Fields of a problem: names, ranges, times, and dense lattices of subtrees."""

    def __init__(self, sparse: DataFrame, info: list[tuple[str, float | None, float | None, bool]], frames: int, depth: int, dim: int):
        self.sparse, self.info, self.frames, self.depth, self.dim = sparse, {n: (lo, hi, a) for n, lo, hi, a in info}, frames, depth, dim

    def names(self) -> list[str]:
        return list(self.info)

    def resolved(self, name: str) -> str:
        """The field, or the first one for an unknown name."""
        return name if name in self.info else next(iter(self.info))

    def range(self, name: str) -> tuple[float | None, float | None]:
        if name not in self.info:
            raise KeyError(name)
        return self.info[name][:2]

    def time_count(self) -> int:
        return max(1, self.frames)

    @staticmethod
    def frame_of(time: float) -> int:
        return int(time)

    @staticmethod
    def time_of(frame: int) -> float:
        return float(frame)

    def of_query(self, q: ViewQuery, secondary: bool = False) -> DataFrame:
        """The sparse values that a query needs: pruned by field, frame, level and index box before anything else."""
        name = self.resolved(q.secondary if secondary else q.primary)
        frame = q.frame if self.info[name][2] else 0
        rows = self.sparse.where((F.col("field") == name) & (F.col("frame") == frame))
        if q.level >= 0:
            rows = rows.where(F.col("level") == q.level)
        if q.index_box:
            for n, lo, hi in zip(index_names(self.dim), *q.index_box, strict=True):
                rows = rows.where((F.col(n) >= lo) & (F.col(n) < hi))
        return rows

    def dense(self, q: ViewQuery) -> DataFrame:
        """Dense lattices of the subtrees in view."""
        rows = self.of_query(q)
        return dense.fill(rows.select("level", *index_names(self.dim), *node_names(self.dim), "value"), ["level", *index_names(self.dim)], self.dim, self.depth)

    def dense_size(self) -> int:
        return dense.dense_size(self.depth, self.dim)


def nearest_time(query_times: DataFrame, frame_times: DataFrame, t: str, frame: str) -> DataFrame:
    """For each query time the frame whose time is nearest (the lower number on a tie); null times have none.

    Both are put in order of time by one range sort; a query looks at the frames before and after it there, and
    over the partitions' edges by one small row for each.
    """
    others = query_times.columns
    frames = frame_times.groupBy(t).agg(F.min(frame).alias(frame)).where(F.col(t).isNotNull())
    asked = query_times.select(F.col(t).cast("double").alias("_t"), F.struct(*others).alias("_q"), F.lit(None).cast(frames.schema[frame].dataType).alias("_f"))
    known = frames.select(F.col(t).cast("double").alias("_t"), F.lit(None).cast(asked.schema["_q"].dataType).alias("_q"), F.col(frame).alias("_f"))
    rows = asked.unionByName(known).repartitionByRange("_t", F.xxhash64("_q", "_f")).sortWithinPartitions("_t")
    rows = rows.withColumn("_part", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    mark = F.when(F.col("_f").isNotNull(), F.struct("_t", "_f"))
    ahead, back = (Window.partitionBy("_part").orderBy(o) for o in (F.col("_i"), F.col("_i").desc()))
    rows = keep(rows.withColumn("_a", F.last(mark, ignorenulls=True).over(ahead)).withColumn("_b", F.last(mark, ignorenulls=True).over(back)), "times")
    edge = rows.groupBy("_part").agg(F.max_by("_a", "_i").alias("_last"), F.min_by("_b", "_i").alias("_first"))
    parts = Window.orderBy("_part")
    edge = edge.select("_part", F.last("_last", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("_la"), F.first("_first", ignorenulls=True).over(parts.rowsBetween(1, Window.unboundedFollowing)).alias("_fb"))
    found = rows.where("_q is not null").join(sized(edge), "_part")
    sides = [F.coalesce("_a", "_la"), F.coalesce("_b", "_fb")]
    choice = F.array_min(F.array(*(F.when(s.isNotNull(), F.struct(F.abs(s["_t"] - F.col("_t")).alias("d"), s["_f"].alias("f"))) for s in sides)))
    out = found.where("_t is not null").select("_q.*", choice["f"].alias(frame))
    return out.unionByName(found.where("_t is null").select("_q.*", F.lit(None).cast(out.schema[frame].dataType).alias(frame)))


class Workers:
    """Named implementations of a renderer."""

    def __init__(self):
        self.made: dict[str, Any] = {}

    def register(self, name: str, factory) -> None:
        self.made[name] = factory

    def create(self, name: str = "Default"):
        if name not in self.made:
            raise KeyError(f"no worker named {name}")
        return self.made[name]()


def render_tasks(n_workers: int, n_nodes: int) -> list[tuple[str, str]]:
    """Edges of a frame's task graph: renders of each node assembled in pairs, then nodes in pairs, then composed."""
    edges: list[tuple[str, str]] = []

    def pairs(items: list[str], prefix: str) -> str:
        step = 0
        while len(items) > 1:
            new = []
            for i in range(0, len(items) - 1, 2):
                name = f"{prefix}{step}"
                step += 1
                edges.extend([(items[i], name), (items[i + 1], name)])
                new.append(name)
            items = new + items[len(items) - len(items) % 2 :]
        return items[0]

    per_node = [pairs([f"render{n}.{w}" for w in range(n_workers)], f"assemble{n}.") for n in range(n_nodes)]
    edges.append((pairs(per_node, "join"), "compose"))
    return edges
