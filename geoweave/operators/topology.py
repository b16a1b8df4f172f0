"""Planar subdivision of line segments: noding, half-edges, faces.

Node keys are coordinates rounded to a fixed grid (`GRID` units), packed into one
BIGINT, so equality of nodes is equality of integers. Orbits of half-edges are
followed inside tiles of a map; what goes on beyond its tile is labelled by pointer doubling.
Edges with the same orbit on both sides are dangles and bridges; they bound no
face and go before the second labelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions import geometry as g
from geoweave.operators.graphs import cycle_labels
from geoweave.operators.pairs import cuts, measured
from geoweave.operators.spatial import range_join, reaching
from geoweave.scratch import materialize

GRID = 1024.0
_HALF = 1 << 31


def node_key(x, y, grid: float = GRID) -> Column:
    kx, ky = F.bround(g.col(x) * grid).cast("long"), F.bround(g.col(y) * grid).cast("long")
    return F.shiftleft(kx + F.lit(_HALF), 31) + (ky + F.lit(_HALF >> 1))


def node_x(key, grid: float = GRID) -> Column:
    return (F.shiftright(g.col(key), 31) - F.lit(_HALF)) / grid


def node_y(key, grid: float = GRID) -> Column:
    return (g.col(key).bitwiseAND(F.lit((1 << 31) - 1)) - F.lit(_HALF >> 1)) / grid


def snap_ends(segments: DataFrame, tolerance: float, scales: DataFrame | None = None) -> DataFrame:
    """Segment ends within ``tolerance`` of others move to the least of those places."""
    if tolerance <= 0:
        return segments
    ends = segments.select("map_id", F.inline(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))).distinct()
    box = ("x", "y", "x", "y")
    ends = reaching(ends, tolerance, scales)
    apart = F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y"))
    near = range_join(ends, ends, F.greatest(4 * F.col("reach"), F.lit(8.0)), apart <= F.col("l.reach"), pad=F.col("reach"), left_box=box, right_box=box)
    to = near.groupBy("l.map_id", "l.x", "l.y").agg(F.min(F.struct("r.x", "r.y")).alias("to"))
    a = to.select("map_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("to.x").alias("ax"), F.col("to.y").alias("ay"))
    b = to.select("map_id", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("to.x").alias("bx"), F.col("to.y").alias("by"))
    moved = segments.join(a, ["map_id", "x1", "y1"]).join(b, ["map_id", "x2", "y2"])
    kept = [c for c in segments.columns if c not in ("x1", "y1", "x2", "y2")]
    return moved.select(*kept, F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2")).filter("x1 <> x2 OR y1 <> y2")


def _cuts(segments: DataFrame, cell: float) -> DataFrame:
    """(map_id, seg_id, x1..y2, t): every cut of every segment with its coordinates; places may come more than once."""
    xy = ("x1", "y1", "x2", "y2")
    s = segments.select("map_id", "seg_id", *[F.col(c).cast("double").alias(c) for c in xy])
    # two segments meet once, and each is cut by the other
    pairs = range_join(s, s, cell, (F.col("l.seg_id") < F.col("r.seg_id")) & g.boxes_near("l", "r"))
    met = measured(pairs, [F.col("l.map_id").alias("map_id"), F.col("l.seg_id").alias("a"), F.col("r.seg_id").alias("b")], "l", "r", ("second", *xy, "t"), cuts)
    cut = met.select("map_id", F.when(F.col("second") == 0, F.col("a")).otherwise(F.col("b")).alias("seg_id"), *xy, "t")
    return cut.unionByName(s.withColumn("t", F.explode(F.array(F.lit(0.0), F.lit(1.0)))))


def split_points(segments: DataFrame, cell: float = 64.0) -> DataFrame:
    """(map_id, seg_id, t): where each segment is cut, its ends included; t from 0 to 1."""
    return _cuts(segments, cell).select("map_id", "seg_id", "t").distinct()


def noded_edges(segments: DataFrame, cell: float = 64.0, grid: float = GRID) -> DataFrame:
    """(map_id, u, v): the distinct edges, u < v, between the nodes at which segments meet or end.

    Cuts carry their node, so they are dealt once, by segment; cuts at one place have one node and make no edge.
    """
    x = F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1"))
    y = F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))
    w = Window.partitionBy("map_id", "seg_id").orderBy("t")
    nodes = _cuts(segments, cell).select("map_id", "seg_id", "t", node_key(x, y, grid).alias("n"))
    steps = nodes.withColumn("m", F.lead("n").over(w)).filter("m IS NOT NULL AND m <> n")
    return steps.select("map_id", F.least("n", "m").alias("u"), F.greatest("n", "m").alias("v")).distinct()


def edge_coordinates(edges: DataFrame, grid: float = GRID) -> DataFrame:
    return edges.withColumns({"x1": node_x("u", grid), "y1": node_y("u", grid), "x2": node_x("v", grid), "y2": node_y("v", grid)})


def node_degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("map_id", F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("map_id", "node").agg(F.count("*").alias("degree"))


def orbits(edges: DataFrame, tile: float = 256.0) -> DataFrame:
    """(map_id, u, v, fu, fv): both half-edges of each edge with the least half-edge of their orbit.

    The orbit of a half-edge u-v goes on with the edge at v that comes before v-u
    in the order of angles, so the face lies to its left. Half-edges are dealt by tiles of their map, in
    which most orbits close.
    """
    half = edges.select("map_id", "u", "v").unionByName(edges.select("map_id", F.col("v").alias("u"), F.col("u").alias("v")))
    angle = F.atan2(node_y("v") - node_y("u"), node_x("v") - node_x("u"))
    dealt = half.withColumns({"angle": angle, "tx": F.floor(node_x("u") / tile), "ty": F.floor(node_y("u") / tile)}).repartition("map_id", "tx", "ty")
    w = Window.partitionBy("map_id", "tx", "ty", "u").orderBy("angle", "v")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = dealt.withColumn("p", F.coalesce(F.lag("v").over(w), F.last("v").over(whole)))
    # the half-edge v-u is followed by u-p
    found = cycle_labels(before.select("map_id", F.col("v").alias("u"), F.col("u").alias("v"), F.col("u").alias("ju"), F.col("p").alias("jv")))
    return found.select("map_id", "u", "v", F.col("lu").alias("fu"), F.col("lv").alias("fv"))


def bounding_edges(edges: DataFrame) -> DataFrame:
    """The edges with different faces on their sides: no dangles, no bridges."""
    sides = orbits(edges).groupBy("map_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    least = sides.agg(F.min("fu").alias("fu"), F.max("fu").alias("gu"), F.min("fv").alias("fv"), F.max("fv").alias("gv"))
    return least.filter("fu <> gu OR fv <> gv").select("map_id", "u", "v")


def faces(segments: DataFrame, snap: float = 0.0, cell: float = 64.0, scales: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(faces, face_edges) of the subdivision.

    faces: map_id, face_id, area (holes taken off), perimeter, x_min..y_max, n_edges;
    face_edges: map_id, face_id, ring (shell or hole), x1, y1, x2, y2.
    """
    edges = materialize(noded_edges(snap_ends(segments, snap, scales), cell), "edges")
    ring = materialize(orbits(materialize(bounding_edges(edges), "edges")), "rings")
    lines = ring.select("map_id", F.concat_ws("-", "fu", "fv").alias("ring_id"), node_x("u").alias("x1"), node_y("u").alias("y1"), node_x("v").alias("x2"), node_y("v").alias("y2"))
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    rings = lines.groupBy("map_id", "ring_id").agg(area.alias("area"), F.sum(g.length()).alias("perimeter"), F.min("x1").alias("x_min"), F.min("y1").alias("y_min"), F.max("x1").alias("x_max"), F.max("y1").alias("y_max"), F.count("*").alias("n_edges"), F.min(F.struct("x1", "y1")).alias("corner"))
    rings = materialize(rings, "rings")
    shells, outer = rings.filter("area > 0"), rings.filter("area < 0")
    # a component's outer ring is a hole of the smallest face around it
    corners = outer.select("map_id", F.col("ring_id").alias("hole"), F.col("corner.x1").alias("x"), F.col("corner.y1").alias("y"))
    around = points_in_rings(corners, lines, "hole", "ring_id", boxes=shells).join(shells.select("map_id", "ring_id", "area"), ["map_id", "ring_id"])
    # read for the faces and for their edges
    holes = materialize(around.groupBy("map_id", "hole").agg(F.min_by("ring_id", F.struct("area", "ring_id")).alias("face_id")), "holes")
    hole_sums = holes.join(outer.select("map_id", F.col("ring_id").alias("hole"), F.col("area").alias("hole_area"), F.col("perimeter").alias("hole_perimeter")), ["map_id", "hole"]).groupBy("map_id", "face_id").agg(F.sum("hole_area").alias("hole_area"), F.sum("hole_perimeter").alias("hole_perimeter"))
    out = shells.withColumnRenamed("ring_id", "face_id").join(hole_sums, ["map_id", "face_id"], "left")
    out = out.select("map_id", "face_id", (F.col("area") + F.coalesce("hole_area", F.lit(0.0))).alias("area"), (F.col("perimeter") + F.coalesce("hole_perimeter", F.lit(0.0))).alias("perimeter"), "x_min", "y_min", "x_max", "y_max", "n_edges").filter("area > 0")
    # every ring bounds one face at most, so its lines are dealt once
    bounds = shells.select("map_id", "ring_id", F.col("ring_id").alias("face_id"), F.lit("shell").alias("ring")).unionByName(holes.select("map_id", F.col("hole").alias("ring_id"), "face_id", F.lit("hole").alias("ring")))
    return materialize(out, "faces"), materialize(lines.join(bounds, ["map_id", "ring_id"]).select("map_id", "face_id", "ring", "x1", "y1", "x2", "y2"), "face_edges")


def points_in_rings(points: DataFrame, lines: DataFrame, point_id: str, ring_id: str, stripe: float = 32.0, cell: float = 64.0, boxes: DataFrame | None = None) -> DataFrame:
    """(map_id, point_id, ring_id) of points strictly inside closed rings.

    Points meet the rings' boxes on a grid first, and then only the lines of the rings whose box they lie in. ``boxes`` (x_min..y_max)
    are those of the rings, where they are known.
    """
    lo, hi = (lambda a, b: F.min(F.least(a, b))), (lambda a, b: F.max(F.greatest(a, b)))
    if boxes is None:
        boxes = lines.groupBy("map_id", ring_id).agg(lo("x1", "x2").alias("x_min"), lo("y1", "y2").alias("y_min"), hi("x1", "x2").alias("x_max"), hi("y1", "y2").alias("y_max"))
    boxes = boxes.select("map_id", ring_id, "x_min", "y_min", "x_max", "y_max")
    within = (F.col("l.x") > F.col("r.x_min")) & (F.col("l.x") < F.col("r.x_max")) & (F.col("l.y") > F.col("r.y_min")) & (F.col("l.y") < F.col("r.y_max"))
    near = range_join(points.select("map_id", point_id, "x", "y"), boxes, cell, within, left_box=("x", "y", "x", "y"), right_box=("x_min", "y_min", "x_max", "y_max"))
    return inside_rings(near.select("l.map_id", f"l.{point_id}", f"r.{ring_id}", "l.x", "l.y"), lines, point_id, ring_id, stripe)


def inside_rings(points: DataFrame, lines: DataFrame, point_id: str, ring_id: str, stripe: float = 32.0) -> DataFrame:
    """The (map_id, point_id, ring_id) of points (with x, y) strictly inside the ring that they name: odd crossings to the right, and on no line.

    Only lines of that ring in the point's horizontal stripe are looked at; a long line is in every stripe that it passes.
    """
    p = points.select("map_id", point_id, ring_id, "x", "y", F.floor(F.col("y") / stripe).alias("stripe"))
    lo, hi = F.floor(F.least("y1", "y2") / stripe), F.floor(F.greatest("y1", "y2") / stripe)
    e = lines.select("map_id", ring_id, "x1", "y1", "x2", "y2", F.explode(F.sequence(lo, hi)).alias("stripe"))
    j = p.join(e.hint("merge"), ["map_id", ring_id, "stripe"])
    straddles = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    side = g.turn("x1", "y1", "x2", "y2", "x", "y")
    right = straddles & F.when(F.col("y2") > F.col("y1"), side > 0).otherwise(side < 0)
    on = (side == 0) & F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("y").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    # a point has one stripe, so what the join has dealt is not shuffled again
    hits = j.filter(straddles | on).groupBy("map_id", ring_id, "stripe", point_id).agg(F.count_if(right).alias("n"), F.bool_or(on).alias("on"))
    return hits.filter("n % 2 = 1 AND NOT `on`").select("map_id", point_id, ring_id)
