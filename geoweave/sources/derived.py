"""Maps derived from the supplied tables by integer arithmetic, so that engines agree exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.streaming.progress import STEPS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The same text runs in Spark and in DuckDB.
SEGMENTS = """SELECT o_orderkey - o_orderkey % 500 AS map_id, o_orderkey AS seg_id,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'route' ELSE 'green' END AS layer,
 (o_orderkey * 7919) % 1000 AS x1, (o_orderkey * 104729) % 600 AS y1,
 (o_orderkey * 7919) % 1000 + (o_orderkey * 31) % 81 - 40 AS x2,
 (o_orderkey * 104729) % 600 + (o_orderkey * 17) % 81 - 40 AS y2 FROM orders"""

LABELS = """SELECT o_orderkey - o_orderkey % 500 AS map_id, o_orderkey AS label_ord,
 CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN CAST(100 + o_orderkey % 700 AS VARCHAR(9))
  WHEN 1 THEN concat(CAST(100 + o_orderkey % 700 AS VARCHAR(9)), '/', CAST(1 + o_orderkey % 20 AS VARCHAR(9)))
  WHEN 2 THEN concat('7', CAST(100 + o_orderkey % 700 AS VARCHAR(9)))
  WHEN 3 THEN concat(CAST(100 + o_orderkey % 700 AS VARCHAR(9)), CAST(1 + o_orderkey % 9 AS VARCHAR(9)))
  WHEN 4 THEN concat(CAST(100 + o_orderkey % 700 AS VARCHAR(9)), '/') ELSE concat('n', CAST(o_orderkey % 50 AS VARCHAR(9))) END AS text,
 CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS conf,
 CASE WHEN o_orderkey % 4 = 0 THEN 'easy_high' WHEN o_orderkey % 4 = 1 THEN 'tess' ELSE 'easy' END AS source,
 (o_orderkey * 6007) % 1000 + 0.5e0 AS x, (o_orderkey * 50021) % 600 + 0.25e0 AS y FROM orders"""

#: Readings that crowd a few places of each map, for the positional folds.
READINGS = """SELECT o_orderkey - o_orderkey % 500 AS map_id, o_orderkey AS ord,
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(10 + o_orderkey % 4 AS VARCHAR(9)) WHEN o_orderkey % 3 = 1 THEN CAST(100 + 10 * (o_orderkey % 4) AS VARCHAR(9))
  ELSE concat(CAST(100 + 10 * (o_orderkey % 4) AS VARCHAR(9)), '/', CAST(1 + o_orderkey % 2 AS VARCHAR(9))) END AS text,
 CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS conf, CASE WHEN o_orderkey % 5 = 0 THEN 'tess' ELSE 'easy' END AS source,
 CAST((o_orderkey % 40) * 50 + (o_orderkey * 13) % 23 AS DOUBLE) AS x, CAST((o_orderkey * 29) % 17 AS DOUBLE) AS y FROM orders"""

RECTANGLES = """SELECT CAST(c_custkey - c_custkey % 50 AS BIGINT) AS map_id, CAST(c_custkey AS BIGINT) AS face_id,
 CAST((c_custkey % 10) * 100 AS DOUBLE) AS x0, CAST(((c_custkey % 50) // 10) * 100 AS DOUBLE) AS y0,
 CAST((c_custkey % 10) * 100 + 40 + c_custkey % 60 AS DOUBLE) AS x1, CAST(((c_custkey % 50) // 10) * 100 + 30 + c_custkey % 70 AS DOUBLE) AS y1 FROM customer"""

def _view(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    sql = sql.replace(" // ", " div ").replace(f"FROM {source}", "FROM {source}")
    return spark.sql(sql, source=table(spark, sf_dir, source))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SEGMENTS, "orders")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, LABELS, "orders")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, READINGS, "orders")


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, RECTANGLES, "customer")


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with colours, widths and items of the three kinds, one for each order."""
    k = F.col("o_orderkey")
    shade = lambda *v: F.struct(*[F.lit(x).alias(c) for x, c in zip(v, "rgb")])
    color = F.when(k % 7 == 0, shade(0.05, 0.6, 0.05)).when(k % 7 == 1, shade(0.98, 0.02, 0.01)).when(k % 7 == 2, shade(0.9, 0.1, 0.95)).when(k % 7 == 3, shade(0.3, 0.5, 0.1)).when(k % 7 == 4, shade(0.0, 0.0, 0.0)).when(k % 7 == 5, shade(0.9, 0.4, 0.4))
    x, y = (k * 7919) % 1000, (k * 104729) % 600
    point = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    line = F.struct(F.lit("l").alias("kind"), F.array(point(0, 0), point(k % 11, 3)).alias("pts"))
    curve = F.struct(F.lit("c").alias("kind"), F.array(point(0, 0), point(1, 9), point(5, 9), point(7, k % 5)).alias("pts"))
    box = F.struct(F.lit("re").alias("kind"), F.array(point(0, 0), point(4 + k % 9, 6)).alias("pts"))
    quad = F.struct(F.lit("qu").alias("kind"), F.array(point(0, 0), point(1, 0), point(1, 1), point(0, 1)).alias("pts"))
    items = F.when(k % 4 == 0, F.array(line, curve)).when(k % 4 == 1, F.array(box)).when(k % 4 == 2, F.array(line, line, quad)).otherwise(F.array(curve))
    rect = F.struct(x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 5 + k % 40).cast("double").alias("x1"), (y + 5 + k % 25).cast("double").alias("y1"))
    kind = F.when(k % 5 == 0, "f").when(k % 5 == 1, "fs").otherwise("s")
    return table(spark, sf_dir, "orders").select((k - k % 500).alias("map_id"), k.alias("drawing_id"), kind.alias("type"), color.alias("color"), ((k % 8) / 4).alias("width"), rect.alias("rect"), items.alias("items"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events: a user's events are a job's steps, in the order of their ids."""
    names = F.array(*[F.lit(k) for k, _, _ in STEPS])
    e = table(spark, sf_dir, "events")
    idx = (F.col("event_id") % 9).cast("int")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.get(names, idx).alias("step"), idx.alias("idx"), (F.col("event_id") % 3 == 0).alias("complete"))
