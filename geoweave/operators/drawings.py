"""Drawings: layers, glyphs, flattening of path items to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.functions import colors


def classify(drawings: DataFrame, strict: bool = False) -> DataFrame:
    """Stroked drawings with their layer, green or route; with ``strict`` a route is red and wider than 1.

    Fills are left out, and so are green glyphs: small paths of several items.
    """
    layered = drawings.filter("type <> 'f'").withColumn("layer", colors.layer_of(strict=strict)).filter("layer IS NOT NULL")
    if strict:
        return layered.filter("layer = 'green' OR width > 1.0")
    return layered.filter(~is_glyph())


def is_glyph():
    return (F.col("layer") == "green") & (F.size("items") > 1) & (F.col("rect.x1") - F.col("rect.x0") < 30) & (F.col("rect.y1") - F.col("rect.y0") < 20)


def flatten(drawings: DataFrame) -> DataFrame:
    """(map_id, drawing_id, item, side, layer, x1, y1, x2, y2): lines, chords of curves, sides of rectangles; no zero lengths.

    Rectangles give their top, right, bottom and left side in turn; other kinds
    of items give nothing.
    """
    items = drawings.select("map_id", "drawing_id", "layer", F.posexplode("items").alias("item", "it"))
    p = lambda i: F.get("it.pts", F.lit(i))
    seg = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    x0, y0, x1, y1 = p(0)["x"], p(0)["y"], p(1)["x"], p(1)["y"]
    sides = F.array(seg(x0, y0, x1, y0), seg(x1, y0, x1, y1), seg(x1, y1, x0, y1), seg(x0, y1, x0, y0))
    segs = F.when(F.col("it.kind") == "l", F.array(seg(x0, y0, x1, y1))).when(F.col("it.kind") == "c", F.array(seg(x0, y0, p(3)["x"], p(3)["y"]))).when(F.col("it.kind") == "re", sides)
    flat = items.select("map_id", "drawing_id", "item", "layer", F.posexplode(segs).alias("side", "s"))
    return flat.select("map_id", "drawing_id", "item", "side", "layer", "s.*").filter("x1 <> x2 OR y1 <> y2")


def skipped_items(drawings: DataFrame) -> DataFrame:
    """How many items of each kind give no segment."""
    return drawings.select("map_id", F.explode("items.kind").alias("kind")).filter("kind NOT IN ('l', 'c', 're')").groupBy("map_id", "kind").agg(F.count("*").alias("n"))


def color_widths(drawings: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most frequent pairs of colour and width."""
    c = drawings.groupBy("color.r", "color.g", "color.b", "width").agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), F.asc_nulls_first("r"), F.asc_nulls_first("g"), F.asc_nulls_first("b"), "width").limit(n)
