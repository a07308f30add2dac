"""Connected components of an edge table: union-find within parts of it, then hooking and pointer jumping.

Every pass begins with the edges of each task reduced to a spanning forest of what the task holds, before
anything is shuffled, so a hub or a dense group sends at most one edge a node and task. What is left is nearly a
forest already; each node hooks to its smallest neighbour, trees are flattened, and the few edges between trees
make the next, much smaller graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octavo.llm.shared import keep, scratch, sized

#: Rounds after which no convergence is an error; each at least halves the depth of trees or the number of nodes that hook.
ROUNDS = 60
#: Edges that are reduced at once in a worker.
CHUNK = 1 << 20


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that is not the smallest of its component in these edges, and that smallest node."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(lx, ly)[apart], np.minimum(lx, ly)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    child = np.flatnonzero(label != np.arange(len(ids)))
    return ids[child], ids[label[child]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (x, y), x > y, with the same components: a spanning forest of each task's edges, in bounded pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            x, y = spanning(*np.concatenate(held, axis=1))
            held[:] = [np.stack([x, y])]
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]))
            if sum(h.shape[1] for h in held) > CHUNK:
                made = flush()
                if held[0].shape[1] > CHUNK // 2:  # the forest itself is large: it goes out, the next begins anew
                    held.clear()
                    yield made
        if held:
            yield flush()

    return edges.mapInArrow(run, "x bigint, y bigint")


def flat(parent: DataFrame) -> DataFrame:
    """(id, label): the roots of a forest given as (id, label) with one row for each node that has a parent."""
    labels = parent
    for _ in range(ROUNDS):
        # nodes that are parents and have one themselves; a root, however many nodes it has, is not among them
        inner = labels.join(labels.select("label").distinct().withColumnRenamed("label", "id"), "id", "left_semi")
        inner = keep(inner.select(F.col("id").alias("via"), F.col("label").alias("further")), "inner")
        n = inner.count()
        if not n:
            return labels
        jumped = labels.join(sized(inner, n), labels["label"] == inner["via"], "left")
        labels = keep(jumped.select("id", F.coalesce("further", "label").alias("label")), "labels")
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For every id in an edge: (id, label), label the smallest id of its component.

    Edges with nulls are ignored, as are loops. Tables are written to the shared folder, so lineage stays short
    and a lost executor costs one round; but the result they go at the end.
    """
    with scratch(edges.sparkSession):
        return keep(_components(edges, a, b), "components", outer=True)


def _components(edges: DataFrame, a: str, b: str) -> DataFrame:
    linked = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x is not null and y is not null and x <> y")
    e = keep(contracted(linked), "edges")
    e = keep(contracted(e.repartition("x")), "edges")
    whole: DataFrame | None = None
    for _ in range(ROUNDS):
        parent = keep(e.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("label")), "parents")
        labels = flat(parent)
        if whole is None:
            whole = labels
        else:
            # what were roots may hang on others now, and nodes first seen here are roots' new children
            next_ = labels.select(F.col("id").alias("via"), F.col("label").alias("further"))
            moved = whole.join(sized(next_), F.col("label") == F.col("via"), "left").select("id", F.coalesce("further", "label").alias("label"))
            whole = keep(moved.unionByName(labels), "labels")
        between = e.join(parent, e["x"] == parent["id"]).where("y <> label").select("x", "y")
        rows = keep(between, "between")
        n = rows.count()
        if not n:
            roots = whole.select(F.col("label").alias("id")).distinct().withColumn("label", F.col("id"))
            return whole.unionByName(roots)
        for end in ("x", "y"):
            to = labels.select(F.col("id").alias("via"), F.col("label").alias("further"))
            rows = rows.join(to, F.col(end) == F.col("via"), "left").withColumn(end, F.coalesce("further", end)).drop("via", "further")
        rows = rows.where("x <> y").distinct()
        e = keep(contracted(rows.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))), "edges")
        if e.isEmpty():
            roots = whole.select(F.col("label").alias("id")).distinct().withColumn("label", F.col("id"))
            return whole.unionByName(roots)
    raise RuntimeError("components did not settle")
