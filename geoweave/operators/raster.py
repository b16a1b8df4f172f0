"""The raster track: boundaries as pixels, background regions as runs of pixels.

A map is never held as an image. In each line of a map the background between boundary pixels
falls into runs, runs of neighbouring lines that touch are linked, and regions are the components of those links.
Distances from the boundary are exact and kept as parts of lines, not as pixels.

A boundary is a table of pixels (map_id, px, py) or of segments (map_id, x1..y2). Maps are swept by bands of
lines; regions are found in each band first, and only the parts that touch another band are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions import geometry as g
from geoweave.operators import tiles
from geoweave.operators.graphs import components
from geoweave.operators.spatial import range_join
from geoweave.scratch import materialize


#: What a run of pixels is.
LINE = "py long, lo long, hi long"


def rasterize(segments: DataFrame, scale: float = 1.0) -> DataFrame:
    """(map_id, seg_id, px, py): the pixels of each segment, one for each step along its longer axis."""
    p = [F.bround(F.col(c) * scale).cast("long") for c in ("x1", "y1", "x2", "y2")]
    s = segments.select("map_id", "seg_id", *[v.alias(n) for v, n in zip(p, ("a", "b", "c", "d"))])
    steps = F.greatest(F.abs(F.col("c") - F.col("a")), F.abs(F.col("d") - F.col("b")))
    each = s.withColumn("n", steps).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    at = lambda u, v: F.col(u) + F.when(F.col("n") > 0, F.bround((F.col(v) - F.col(u)) * F.col("k") / F.col("n"))).otherwise(0).cast("long")
    return each.select("map_id", "seg_id", at("a", "c").alias("px"), at("b", "d").alias("py"))


def thicken(pixels: DataFrame, radius: int) -> DataFrame:
    """Pixels within a disc of ``radius`` around pixels."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disc(radius)])
    return pixels.select("map_id", "px", "py", F.inline(offsets)).select("map_id", (F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py")).distinct()


def disc(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]


def thinned(pixels: DataFrame, radius: int) -> DataFrame:
    """Pixels whose whole disc of ``radius`` is among the pixels."""
    offsets = disc(radius)
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    around = pixels.select("map_id", "px", "py").distinct().select("map_id", "px", "py", F.inline(moves))
    held = around.groupBy("map_id", (F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py")).agg(F.count("*").alias("n"))
    return held.filter(F.col("n") == len(offsets)).select("map_id", "px", "py")


def strokes(boundary: DataFrame, scale: float = 1.0) -> DataFrame:
    """(map_id, a, b, c, d): pixels, or segments times ``scale``, from pixel a, b to pixel c, d."""
    ends = ("px", "py", "px", "py") if "px" in boundary.columns else ("x1", "y1", "x2", "y2")
    pixel = lambda c: F.col(c).cast("long") if c in ("px", "py") else F.bround(F.col(c) * scale).cast("long")
    return boundary.select("map_id", *[pixel(c).alias(n) for c, n in zip(ends, "abcd")])


def closed(boundary: DataFrame, radius: int = 2) -> DataFrame:
    """Morphological closing: thickened, then thinned again, which joins what lies within twice the radius."""

    def run(runs, top, bottom, width, height):
        return tiles.closed(runs, radius, top, bottom)

    return tiles.swept(strokes(boundary), None, 2 * radius, run, "px long, py long")


def kept_regions(sizes: DataFrame, least: int, most: int, held: DataFrame | None = None) -> DataFrame:
    """Regions that touch no edge, of ``least`` to ``most`` pixels; larger ones too if ``held`` (map_id, region) names them."""
    inner = sizes.filter("NOT touches_edge").filter(F.col("n") >= least)
    if held is None:
        return inner.filter(F.col("n") <= most)
    marked = inner.join(held.select("map_id", "region").distinct().withColumn("held", F.lit(True)), ["map_id", "region"], "left")
    return marked.filter((F.col("n") <= most) | F.col("held")).drop("held")


def background_runs(boundary: DataFrame, pages: DataFrame) -> DataFrame:
    """(map_id, run, py, lo, hi): maximal runs of pixels that are no boundary; pages has map_id, width and height in pixels."""

    def run(runs, top, bottom, width, height):
        return tiles.free(runs, top, bottom, width)[1:]

    return tiles.swept(strokes(boundary), pages, 0, run, LINE).withColumn("run", run_id())


def in_pages(boundary: DataFrame, pages: DataFrame) -> DataFrame:
    """The distinct boundary pixels that lie on their page."""
    on_page = boundary.join(pages, "map_id").filter("px BETWEEN 0 AND width - 1 AND py BETWEEN 0 AND height - 1")
    return on_page.select("map_id", "px", "py").distinct()


def nearest_in_columns(boundary: DataFrame, pages: DataFrame, reach: float) -> DataFrame:
    """(map_id, at, x_lo, x_hi, y_lo, y_hi): boxes of pixels whose column has its nearest boundary pixel in line ``at``.

    This is the first pass of a separable distance transform: every boundary pixel owns
    the part of its column halfway to the next ones, ``reach`` at most. Neighbouring columns with the
    same part make one box, so a straight edge along a line is one row, and no image is held.
    """
    column = Window.partitionBy("map_id", "px").orderBy("py")
    above, below = F.lag("py").over(column), F.lead("py").over(column)
    far = int(reach)
    half = lambda other: F.floor((other + F.col("py")) / 2)
    own = in_pages(boundary, pages).join(pages.select("map_id", "height"), "map_id").select(
        "map_id", "px", F.col("py").alias("at"),
        F.greatest(F.lit(0), F.col("py") - far, half(above) + 1).alias("y_lo"),
        F.least(F.col("height") - 1, F.col("py") + far, half(below)).alias("y_hi"),
    )
    same = ["map_id", "at", "y_lo", "y_hi"]
    island = F.col("px") - F.row_number().over(Window.partitionBy(*same).orderBy("px"))
    boxes = own.withColumn("island", island).groupBy(*same, "island").agg(F.min("px").alias("x_lo"), F.max("px").alias("x_hi"))
    return boxes.select("map_id", "at", "x_lo", "x_hi", "y_lo", "y_hi")


def near_intervals(boundary: DataFrame, pages: DataFrame, reach: float) -> DataFrame:
    """(map_id, py, off, x_lo, x_hi, lo, hi): parts of lines within ``reach`` of the boundary pixels ``off`` lines away.

    The pixels in x_lo..x_hi have a boundary pixel in their own column; those from lo to hi
    are within ``reach`` of one. A nearer pixel of the same column covers all that a farther one
    does, so the second pass of the transform needs no others.
    """
    rows = nearest_in_columns(boundary, pages, reach).withColumn("py", F.explode(F.sequence("y_lo", "y_hi")))
    off = F.abs(F.col("py") - F.col("at"))
    wide = F.floor(F.sqrt(F.lit(float(reach) ** 2) - off * off))
    return rows.select("map_id", "py", off.alias("off"), "x_lo", "x_hi", (F.col("x_lo") - wide).alias("lo"), (F.col("x_hi") + wide).alias("hi"))


def far_runs(boundary: DataFrame, pages: DataFrame, most: float) -> DataFrame:
    """(map_id, py, lo, hi): runs of pixels that lie farther than ``most`` from every boundary pixel of their page."""

    def run(runs, top, bottom, width, height):
        return tiles.free(tiles.widened(tiles.on_page(runs, width, height), most), top, bottom, width)[1:]

    return tiles.swept(strokes(boundary), pages, int(most), run, LINE)


def clearances(points: DataFrame, segments: DataFrame, pages: DataFrame, point_id: str, reach: float, cell: int = 64) -> DataFrame:
    """``distances_at`` of the segments' pixels: only those near a point are drawn, and no pixel is shuffled.

    Points meet the segments within reach first; each such segment is drawn on the lines within ``reach`` of the point.
    """
    lines = strokes(segments).join(pages.select("map_id", "width", "height"), "map_id")
    # pixels lie within half a pixel of their segment
    near = g.point_segment_distance("l.px", "l.py", "r.a", "r.b", "r.c", "r.d") <= reach + 1
    pairs = range_join(points.select("map_id", point_id, "px", "py"), lines, cell, near, pad=reach + 1, left_box=("px", "py", "px", "py"), right_box=("a", "b", "c", "d"))
    whole = [F.col(c).cast("long").alias(c[2:]) for c in ("l.px", "l.py", "r.a", "r.b", "r.c", "r.d", "r.width", "r.height")]
    pairs = pairs.select("l.map_id", f"l.{point_id}", *whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d2 = tiles.nearest(*(c.to_numpy() for c in batch.columns[2:]), reach)
            some = np.flatnonzero(d2 <= reach * reach)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), pa.array(d2[some])], ["map_id", point_id, "d2"])

    kinds = dict(points.dtypes)
    found = pairs.mapInArrow(run, f"map_id {kinds['map_id']}, {point_id} {kinds[point_id]}, d2 long")
    return found.groupBy("map_id", point_id).agg(F.min("d2").alias("d2"))


def distances_at(points: DataFrame, boundary: DataFrame, pages: DataFrame, point_id: str, reach: float, cell: int = 64) -> DataFrame:
    """(map_id, point_id, d2): squared distance of each pixel px, py from the nearest boundary pixel, up to ``reach``."""
    near = near_intervals(boundary, pages, reach)
    near = near.withColumn("gx", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    dots = points.select("map_id", point_id, "px", "py", F.floor(F.col("px") / cell).alias("gx"))
    met = dots.join(near.hint("merge"), ["map_id", "py", "gx"]).filter("px BETWEEN lo AND hi")
    dx = F.greatest(F.lit(0), F.col("x_lo") - F.col("px"), F.col("px") - F.col("x_hi"))
    return met.groupBy("map_id", point_id).agg(F.min(dx * dx + F.col("off") * F.col("off")).alias("d2"))


def filled_runs(boundary: DataFrame, pages: DataFrame, most: float) -> DataFrame:
    """Background runs once what is farther than ``most`` from the boundary counts as boundary too.

    Leaks between parcels then part from the open background around them.
    """

    def run(runs, top, bottom, width, height):
        return tiles.filled(tiles.on_page(runs, width, height), top, bottom, width, most)[1:]

    return tiles.swept(strokes(boundary), pages, int(most), run, LINE).withColumn("run", run_id())


def run_id(py: str = "py", lo: str = "lo"):
    return F.concat_ws(":", "map_id", F.lpad(F.col(py).cast("string"), 9, "0"), F.lpad(F.col(lo).cast("string"), 9, "0"))


def parts(boundary: DataFrame, pages: DataFrame, fill: float | None = None, scale: float = 1.0, thickness: int = 0) -> DataFrame:
    """(map_id, part, py, lo, hi): background runs with the part of their band that they belong to, named by its first run.

    The boundary may be thickened first. With ``fill`` the runs are those of ``filled_runs``.
    """
    around = thickness + int(fill or 0)

    def run(runs, top, bottom, width, height):
        drawn = tiles.on_page(tiles.widened(runs, thickness), width, height)
        _, py, lo, hi = tiles.free(drawn, top, bottom, width) if fill is None else tiles.filled(drawn, top, bottom, width, fill)
        root = tiles.parts(py, lo, hi)
        return py, lo, hi, py[root], lo[root]

    found = tiles.swept(strokes(boundary, scale), pages, around, run, f"{LINE}, first_py long, first_lo long")
    return materialize(found.select("map_id", run_id("first_py", "first_lo").alias("part"), "py", "lo", "hi"), "parts")


def part_regions(parts_: DataFrame) -> DataFrame:
    """(map_id, part, region) of the parts that touch another band's; of all others the part is the region."""
    last = parts_.filter(F.col("py") % tiles.BAND == tiles.BAND - 1).select("map_id", (F.col("py") + 1).alias("py"), F.col("part").alias("a"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    first = parts_.filter(F.col("py") % tiles.BAND == 0)
    links = last.join(first.hint("merge"), ["map_id", "py"]).filter("lo <= hi2 + 1 AND lo2 <= hi + 1").select("a", F.col("part").alias("b")).distinct()
    return components(links).select(F.col("node").alias("part"), F.col("component").alias("region"))


def regions(boundary: DataFrame, pages: DataFrame, fill: float | None = None, scale: float = 1.0, thickness: int = 0) -> DataFrame:
    """(map_id, region, run, py, lo, hi): background runs with their 8-connected region; with ``fill``, of ``filled_runs``."""
    own = parts(boundary, pages, fill, scale, thickness)
    named = own.join(part_regions(own).hint("merge"), "part", "left").select("map_id", F.coalesce("region", "part").alias("region"), run_id().alias("run"), "py", "lo", "hi")
    return materialize(named, "regions")


def sizes(boundary: DataFrame, pages: DataFrame, fill: float | None = None, scale: float = 1.0, thickness: int = 0) -> DataFrame:
    """``region_sizes`` of the boundary's ``regions``; only one row for each band's part is joined with its region."""
    own = parts(boundary, pages, fill, scale, thickness)
    each = region_sizes(own.withColumnRenamed("part", "region"), pages).withColumnRenamed("region", "part")
    named = each.join(part_regions(own).hint("merge"), "part", "left").withColumn("region", F.coalesce("region", "part"))
    return named.groupBy("map_id", "region").agg(F.sum("n").alias("n"), F.bool_or("touches_edge").alias("touches_edge"))


def region_sizes(regions_: DataFrame, pages: DataFrame) -> DataFrame:
    """(map_id, region, n, touches_edge)."""
    # the page is needed for the least and greatest places only
    held = regions_.groupBy("map_id", "region").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"), F.min("py").alias("py0"), F.max("py").alias("py1"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    edge = (F.col("py0") == 0) | (F.col("py1") == F.col("height") - 1) | (F.col("lo") == 0) | (F.col("hi") == F.col("width") - 1)
    return held.join(pages.hint("merge"), "map_id").select("map_id", "region", "n", edge.alias("touches_edge"))


def regions_at(points: DataFrame, regions_: DataFrame, point_id: str, window: int = 0) -> DataFrame:
    """(map_id, point_id, region): the region of each pixel px, py, or the nearest within a square window; ties to the first."""
    near = points.select("map_id", point_id, "px", "py", F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("dy"))
    near = near.withColumn("py", F.col("py") + F.col("dy"))
    j = near.join(regions_.hint("merge"), ["map_id", "py"]).filter(F.col("px").between(F.col("lo") - window, F.col("hi") + window))
    dx = F.greatest(F.lit(0), F.col("lo") - F.col("px"), F.col("px") - F.col("hi"))
    best = j.groupBy("map_id", point_id).agg(F.min(F.struct((dx * dx + F.col("dy") * F.col("dy")).alias("d"), "region")).alias("m"))
    return best.select("map_id", point_id, F.col("m.region").alias("region"))


def touched_regions(route: DataFrame, regions_: DataFrame, scale: float = 1.0, least: int = 10) -> DataFrame:
    """(map_id, region, n): regions that hold at least ``least`` pixels of the route."""
    pixels = rasterize(route, scale).select("map_id", "px", "py").distinct()
    hit = pixels.join(regions_.hint("merge"), ["map_id", "py"]).filter("px BETWEEN lo AND hi")
    return hit.groupBy("map_id", "region").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
