"""Where intermediate tables are kept, and checks of a size before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be collected or broadcast to all executors; more go through a shuffle join.
BROADCAST_ROWS = 200_000


def local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a cluster that is an error,
    as the executors would not see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='octavo-')}")
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/octavo/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Paths written by ``keep`` inside each open ``scratch``, innermost last, and outside of any.
_OPEN: list[list[str]] = [[]]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside go at the end, but for those kept with ``outer`` (they belong to the scratch around it, if any).

    What leaves the block must therefore not read them any more.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def cleared(spark: SparkSession) -> int:
    """Remove all tables that were kept outside of any scratch, once the results that read them are written: how many."""
    n = len(_OPEN[0])
    while _OPEN[0]:
        remove(spark, _OPEN[0].pop())
    return n


def give_back(spark: SparkSession, tasks: int | None = None) -> None:
    """Let the driver and the executors collect garbage, which gives freed heap back to the system.

    A heap that one step has grown otherwise stays so, and the Python workers of the next share an executor's allowance
    with it. A few tasks without input do it, one for each core; in local mode the driver is the only JVM.
    """
    if tasks is None:
        tasks = 0 if local(spark) else spark.sparkContext.defaultParallelism
    if tasks:
        spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')")).collect()
    spark._jvm.java.lang.System.gc()


#: While a table is written: Spark drops a query's shuffle files at its end rather than when their plan is garbage, and
#: Python workers get batches of a few megabytes, as JVM and workers share an executor's allowance.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(6 << 20)}


def keep(df: DataFrame, name: str, codec: str = "zstd", outer: bool = False) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, and survives lost executors.

    What is written needs its shuffles no more, so their files go at once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _OPEN[max(0, len(_OPEN) - 2) if outer else -1].append(path)
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only for a side whose counted rows are within the limit; else the plain side, for a shuffle join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df
