"""Views of the test tables as points, lattices, voxels, rays and timing records, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int) -> Column:
    """Rounded as SQL rounds doubles: half up after scaling in binary. ``F.round`` goes by the decimal digits, so that ties differ."""
    return F.round(c * 10**digits) / 10**digits


def pts2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"), F.col("p_retailprice").alias("v"), F.col("p_brand").alias("zone"))


def pts3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 500).alias("y"), (F.col("l_tax") * 625).alias("z"), F.col("l_extendedprice").alias("v"), F.col("l_returnflag").alias("zone"))


def emb3(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *(F.get(e, F.lit(k)).cast("double").alias(a) for k, a in enumerate("xyz")), F.col("label").alias("zone"))


def grid2(spark: SparkSession, d: str) -> DataFrame:
    """A 17 x 17 node lattice: zone_id, node_id, ix, iy, x, y, v. Whole values, so that midpoints are exact in binary."""
    ix, iy = (F.col("l_partkey") % 17).cast("int"), (F.col("l_orderkey") % 17).cast("int")
    rows = table(spark, d, "lineitem").groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.round(F.avg("l_extendedprice"), 0).alias("v"))
    return rows.select(F.lit(0).alias("zone_id"), (F.col("iy").cast("long") * 17 + F.col("ix")).alias("node_id"), "ix", "iy", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), "v")


def img2(spark: SparkSession, d: str) -> DataFrame:
    """16 x 16 voxels: ix, iy, n, v."""
    ix, iy = (F.col("l_partkey") % 16).cast("int"), (F.col("l_orderkey") % 16).cast("int")
    return table(spark, d, "lineitem").groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("v"))


def tele(spark: SparkSession, d: str) -> DataFrame:
    """Timing records: frame (day), node, thread, level, stage, t (seconds of the epoch), v, number of the event."""
    # by calendar fields, so that the session's time zone plays no part
    t = F.expr("datediff(cast(ts as date), date'1970-01-01') * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + cast(extract(second from ts) * 1000000 as bigint)")
    return table(spark, d, "events").select(
        F.floor(t / 86_400_000_000).cast("long").alias("frame"), (F.col("user_id") % 4).alias("node"), F.col("user_id").alias("thread"), (F.col("user_id") % 3).alias("level"),
        F.col("event_type").alias("stage"), t.alias("us"), F.col("value").alias("v"), F.col("event_id").alias("n"),
    )


def rays(spark: SparkSession, d: str) -> DataFrame:
    """Samples of rays: pixel, step (by time), v, and a second field w."""
    w = Window.partitionBy("pixel").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("pixel"), "ts", "event_id", F.col("value").alias("v"), (F.col("event_id") % 7).cast("double").alias("w"))
    return rows.withColumn("step", F.row_number().over(w)).select("pixel", "step", "v", "w")


def frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("frame"), F.col("o_orderstatus").alias("field"), F.col("o_totalprice").alias("value"))


#: The same views in SQL, as common table expressions.
SQL = {
    "pts2": "pts2 AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice - 900 AS y, p_retailprice AS v, p_brand AS zone FROM part)",
    "cube2": "b2 AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts2), s2 AS (SELECT *, greatest(x1 - x0, y1 - y0) AS s FROM b2), cube2 AS (SELECT s, x0 - s / 2 + (x1 - x0) / 2 AS mx, y0 - s / 2 + (y1 - y0) / 2 AS my FROM s2)",
    "pts3": "pts3 AS (SELECT l_quantity AS x, l_discount * 500 AS y, l_tax * 625 AS z, l_extendedprice AS v, l_returnflag AS zone FROM lineitem)",
    "cube3": "b3 AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM {p}), s3 AS (SELECT *, greatest(x1 - x0, y1 - y0, z1 - z0) AS s FROM b3), cube3 AS (SELECT s, x0 - s / 2 + (x1 - x0) / 2 AS mx, y0 - s / 2 + (y1 - y0) / 2 AS my, z0 - s / 2 + (z1 - z0) / 2 AS mz FROM s3)",
    "emb3": "emb3 AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label AS zone FROM embeddings)",
    "grid2": "grid2 AS (SELECT 0 AS zone_id, CAST(l_orderkey % 17 AS BIGINT) * 17 + l_partkey % 17 AS node_id, CAST(l_partkey % 17 AS INT) AS ix, CAST(l_orderkey % 17 AS INT) AS iy, CAST(l_partkey % 17 AS DOUBLE) AS x, CAST(l_orderkey % 17 AS DOUBLE) AS y, round(avg(l_extendedprice), 0) AS v FROM lineitem GROUP BY l_partkey % 17, l_orderkey % 17)",
    "elem2": "elem2 AS (SELECT 0 AS zone_id, CAST(j * 16 + i AS BIGINT) AS element_id, CAST(j * 17 + i AS BIGINT) AS n0, CAST(j * 17 + i + 1 AS BIGINT) AS n1, CAST(j * 17 + i + 18 AS BIGINT) AS n2, CAST(j * 17 + i + 17 AS BIGINT) AS n3 FROM (SELECT unnest(generate_series(0, 15)) AS i) a, (SELECT unnest(generate_series(0, 15)) AS j) b)",
    "img2": "img2 AS (SELECT CAST(l_partkey % 16 AS INT) AS ix, CAST(l_orderkey % 16 AS INT) AS iy, count(*) AS n, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY l_partkey % 16, l_orderkey % 16)",
    "tele": "tele AS (SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS frame, user_id % 4 AS node, user_id AS thread, user_id % 3 AS level, event_type AS stage, epoch_us(ts) AS us, value AS v, event_id AS n FROM events)",
    "rays": "rays AS (SELECT user_id AS pixel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS v, CAST(event_id % 7 AS DOUBLE) AS w FROM events)",
    "frames": "frames AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS frame, o_orderstatus AS field, o_totalprice AS value FROM orders)",
}


def with_views(*names: str, body: str) -> str:
    """SQL with the views named before it. ``cube3:emb3`` is the cube of those points."""
    parts = []
    for name in names:
        base, _, points = name.partition(":")
        parts.append(SQL[base].replace("{p}", points or "pts3"))
    return f"WITH {', '.join(parts)}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().lstrip('+')}"
