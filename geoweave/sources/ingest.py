"""Reading maps, readings and ground truth; content keys and caches.

Pages are decoded and read outside the engine. Its inputs are the `drawings` and
`ocr_raw` tables, as Parquet or JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DRAWINGS = "map_id string, drawing_id long, type string, color struct<r:double,g:double,b:double>, width double, rect struct<x0:double,y0:double,x1:double,y1:double>, items array<struct<kind:string,pts:array<struct<x:double,y:double>>>>"
OCR_RAW = "map_id string, ord long, text string, conf double, x double, y double, cx double, cy double, bbox array<struct<x:double,y:double>>, source string"

# Chunk width, overlap, text and low-text thresholds of the reading passes.
PASSES = (("easy", 4000, 400, 0.3, 0.2), ("easy", 2500, 600, 0.2, 0.1), ("easy", 1500, 400, 0.15, 0.08))
HIGH_SCALE = ("easy_high", 2000, 400, 0.05, 0.02)


def read_drawings(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(DRAWINGS).format(format).load(path)


def read_ocr(spark: SparkSession, path: str, ocr_scale: float, format: str = "parquet") -> DataFrame:
    """Readings in points: x, y as they are, or pixel centres (given, or of the box) over the scale."""
    raw = spark.read.schema(OCR_RAW).format(format).load(path)
    mean = lambda c: F.aggregate("bbox", F.lit(0.0), lambda a, p: a + p[c]) / F.size("bbox")
    x = F.coalesce("x", F.col("cx") / ocr_scale, mean("x") / ocr_scale)
    y = F.coalesce("y", F.col("cy") / ocr_scale, mean("y") / ocr_scale)
    return raw.select("map_id", "ord", "text", "conf", x.alias("x"), y.alias("y"), "source")


def list_pages(spark: SparkSession, folder: str, pattern: str = "*.pdf", most_bytes: int = 25 << 20) -> DataFrame:
    """(path, key) of the files in a folder that are not too large; the key is the start of their content's SHA-256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.filter(F.col("length") <= most_bytes).select("path", content_key(F.col("content")).alias("key"))


def content_key(content):
    return F.substring(F.sha2(content, 256), 1, 24)


def cache_misses(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    return wanted.join(cached.select("key"), "key", "left_anti")


def chunk_plan(pages: DataFrame, passes=PASSES) -> DataFrame:
    """(map_id, pass, chunk, left, right): columns of pixels that each reading pass looks at; pages has map_id and width_px."""
    rows = F.array(*[F.struct(F.lit(i).alias("pass"), F.lit(w).alias("w"), F.lit(o).alias("o")) for i, (_, w, o, _, _) in enumerate(passes)])
    each = pages.select("map_id", "width_px", F.inline(rows))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("width_px") - 1, F.lit(0)), (F.col("w") - F.col("o")).cast("long"))
    chunks = each.select("map_id", "width_px", "pass", "w", F.posexplode(starts).alias("chunk", "left"))
    return chunks.select("map_id", "pass", "chunk", "left", F.least(F.col("left") + F.col("w"), F.col("width_px")).alias("right"))


def write_readings(readings: DataFrame, path: str) -> None:
    """The built readings of many maps as a table, by map, for later runs."""
    readings.repartitionByRange("map_id", "ord").sortWithinPartitions("map_id", "ord").write.mode("overwrite").parquet(path)


def rescale_high(raw: DataFrame, ocr_scale: float, high_scale: float = 12.0) -> DataFrame:
    """Boxes of the high-scale pass in the pixels of the others."""
    return raw.withColumn("bbox", F.transform("bbox", lambda p: F.struct((p["x"] * ocr_scale / high_scale).alias("x"), (p["y"] * ocr_scale / high_scale).alias("y")))).withColumn("source", F.lit("easy_high"))


def parse_ground_truth(texts: DataFrame) -> DataFrame:
    """(doc, map_name, text) of ground-truth files (doc, text): `NAME:` begins a map, an empty line ends it, ids by line or comma."""
    lines = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    header = F.when(F.endswith("line", F.lit(":")), F.expr("substring(line, 1, length(line) - 1)")).when(F.col("line") == "", "")
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = lines.withColumn("map_name", F.last(header, ignorenulls=True).over(w)).filter("line <> '' AND NOT endswith(line, ':') AND map_name <> ''")
    each = named.select("doc", "map_name", F.explode(F.split("line", ",")).alias("text"))
    return each.withColumn("text", F.trim("text")).filter("text <> ''").distinct()


def read_flat_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("text")).filter("text <> ''").distinct()
