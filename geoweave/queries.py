"""Queries of the map operators over maps derived from the supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoweave.functions import geometry as g
from geoweave.functions import labels as fl
from geoweave.operators import closures, clusters, corridor, crossing, directions, evaluation, faces, raster, rays, topology
from geoweave.operators import drawings as dr
from geoweave.operators import labels as lb
from geoweave.plans import strategies
from geoweave.sources import derived, ingest
from geoweave.scratch import shared_folder
from geoweave.streaming import inbox, jobs
from geoweave.streaming import progress as pr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _points(spark, d):
    """Ends of route segments, numbered by segment."""
    s = derived.segments(spark, d).filter("layer = 'route'")
    return s.select("map_id", F.col("seg_id").alias("ord"), F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y"), (F.col("x2") - F.col("x1")).cast("double").alias("dx"), (F.col("y2") - F.col("y1")).cast("double").alias("dy"))


@query
def flatten_items(spark, d):
    return dr.flatten(dr.classify(derived.drawings(spark, d)))


@query
def classify_layer(spark, d):
    return dr.classify(derived.drawings(spark, d), strict=True).select("map_id", "drawing_id", "layer", "width")


@query
def glyph_filter(spark, d):
    return dr.classify(derived.drawings(spark, d)).groupBy("map_id", "layer").agg(F.count("*").alias("n"))


@query
def skipped_items(spark, d):
    return dr.skipped_items(derived.drawings(spark, d))


@query
def color_width_top15(spark, d):
    return dr.color_widths(derived.drawings(spark, d))


@query
def width_split(spark, d):
    items = derived.table(spark, d, "lineitem").select((F.col("l_orderkey") - F.col("l_orderkey") % 500).alias("map_id"), (F.pmod(F.col("l_orderkey") * 7 + F.col("l_orderkey") % 500, F.lit(17)) * F.pmod(F.col("l_orderkey"), F.lit(5)) / 8).alias("width"))
    return clusters.width_split(items)


@query
def crossing_pairs(spark, d):
    return crossing.crossing_pairs(derived.segments(spark, d))


@query
def green_crossed_semi(spark, d):
    return crossing.crossed_greens(derived.segments(spark, d)).select("map_id", "seg_id")


@query
def route_extent(spark, d):
    return crossing.route_extent(derived.segments(spark, d))


@query
def route_endpoints(spark, d):
    return crossing.route_endpoints(derived.segments(spark, d))


@query
def segment_angles(spark, d):
    a = directions.segment_angles(derived.segments(spark, d))
    return a.select("map_id", "seg_id", F.round("length", 6).alias("length"), F.round("angle", 6).alias("angle"), F.round("off_axis", 6).alias("off_axis"))


@query
def angle_bucket_best(spark, d):
    return directions.best_bucket(derived.segments(spark, d))


@query
def pca_direction(spark, d):
    a = directions.principal_axis(_points(spark, d), ["map_id"])
    return a.select("map_id", "n", g.rounded("axis", 5).alias("axis"))


@query
def oriented_direction(spark, d):
    a = directions.oriented_sum(derived.segments(spark, d).filter("layer = 'route'"), ["map_id"])
    return a.select("map_id", g.rounded("ux", 6).alias("ux"), g.rounded("uy", 6).alias("uy"))


@query
def cluster_1d(spark, d):
    c = clusters.cluster_1d(derived.segments(spark, d).filter("layer = 'route'"), "x1")
    return c.groupBy("map_id", "cluster").agg(F.count("*").alias("n"), F.min("x1").alias("lo"), F.max("x1").alias("hi"))


@query
def last_kept_thinning(spark, d):
    return clusters.thin(_points(spark, d), 120.0)


@query
def radius_clusters(spark, d):
    c = clusters.radius_clusters(_points(spark, d), 60.0)
    return c.select("map_id", "cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "dx", "dy", "n")


@query
def ring_edges(spark, d):
    r = derived.rectangles(spark, d)
    corner = lambda i, x, y: F.struct(F.lit(i).alias("ord"), F.col(x).alias("x"), F.col(y).alias("y"))
    return clusters.ring_edges(r.select("map_id", "face_id", F.inline(F.array(corner(0, "x0", "y0"), corner(1, "x1", "y0"), corner(2, "x1", "y1"), corner(3, "x0", "y1")))), ["map_id", "face_id"])


@query
def ray_all_hits(spark, d):
    return rays.all_hits(derived.labels(spark, d), derived.segments(spark, d).filter("layer = 'green'"))


@query
def ray_first_hit(spark, d):
    h = rays.first_hits(derived.labels(spark, d), derived.segments(spark, d).filter("layer = 'green'"))
    return h.select("map_id", "label_ord", "ray", "seg_id", F.round("t", 10).alias("t"))


@query
def ray_crossed_labels(spark, d):
    s = derived.segments(spark, d)
    return rays.labels_by_rays(derived.labels(spark, d), s.filter("layer = 'green'"), crossing.crossed_greens(s)).select("map_id", "label_ord", "text")


@query
def ray_first_crossed_labels(spark, d):
    s = derived.segments(spark, d)
    return rays.labels_by_rays(derived.labels(spark, d), s.filter("layer = 'green'"), crossing.crossed_greens(s), first_only=True).select("map_id", "label_ord", "text")


@query
def label_repair(spark, d):
    """Number tokens of the documents and label readings, repaired."""
    words = derived.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]{2,6}"), F.lit(0))).alias("text"))
    all_ = words.unionByName(derived.labels(spark, d).select("text")).distinct()
    return all_.select("text", fl.repair("text").alias("repaired"), fl.repair_reading(F.col("text")).alias("reading"))


@query
def label_filter(spark, d):
    return lb.load(derived.labels(spark, d)).select("map_id", "label_ord", "text", "conf")


@query
def best_label_per_text(spark, d):
    return lb.best_per_text(lb.load(derived.labels(spark, d)))


@query
def closest_label_per_text(spark, d):
    l_ = lb.load(derived.labels(spark, d)).withColumn("dist", F.abs(F.col("x") - 500))
    return lb.closest_per_text(l_)


@query
def one_label_per_face(spark, d):
    l_ = derived.labels(spark, d).withColumn("face_id", F.floor(F.col("x") / 100).cast("int"))
    return lb.one_per_face(l_).select("map_id", "face_id", "label_ord", "text")


@query
def label_dedup(spark, d):
    return lb.positional_dedup(derived.readings(spark, d))


@query
def pass_merge(spark, d):
    return lb.merge_passes(derived.readings(spark, d))


@query
def chunk_merge(spark, d):
    return lb.merge_chunks(derived.readings(spark, d))


@query
def tesseract_gaps(spark, d):
    r = derived.readings(spark, d)
    return lb.fill_gaps(r.filter("source <> 'tess'"), r.filter("source = 'tess'"))


@query
def noded_edges(spark, d):
    return topology.edge_coordinates(topology.noded_edges(derived.segments(spark, d))).select("map_id", "x1", "y1", "x2", "y2")


@query
def face_area(spark, d):
    r = derived.rectangles(spark, d)
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return r.select("map_id", "face_id", g.ring_area("points").alias("area")) if "points" in r.columns else r.withColumn("points", F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))).select("map_id", "face_id", g.ring_area("points").alias("area"))


@query
def point_in_face(spark, d):
    """Labels of the customers' maps in the customers' rectangles, by crossing parity."""
    lines = ring_edges(spark, d)
    c = derived.table(spark, d, "customer")
    points = c.select((F.col("c_custkey") - F.col("c_custkey") % 50).cast("long").alias("map_id"), F.col("c_custkey").cast("long").alias("label_ord"), ((F.col("c_custkey") * 6007) % 1000 + 0.5).cast("double").alias("x"), ((F.col("c_custkey") * 50021) % 500 + 0.25).cast("double").alias("y"))
    return topology.points_in_rings(points, lines, "label_ord", "face_id")


@query
def eval_outcomes(spark, d):
    return evaluation.outcomes(*_found_and_truth(spark, d))


def _found_and_truth(spark, d):
    l_ = derived.labels(spark, d)
    return l_.filter("conf >= 0.2").select("map_id", "text"), l_.filter("y < 480").select("map_id", "text")


@query
def eval_rollup(spark, d):
    return evaluation.counts(evaluation.outcomes(*_found_and_truth(spark, d)))


@query
def set_diff_lists(spark, d):
    return evaluation.differences(evaluation.outcomes(*_found_and_truth(spark, d)))


@query
def variant_report(spark, d):
    found, truth = _found_and_truth(spark, d)
    a = evaluation.outcomes(found, truth).withColumn("variant", F.lit("A"))
    b = evaluation.outcomes(truth, truth).withColumn("variant", F.lit("B"))
    return evaluation.variants(a.unionByName(b))


@query
def gt_parse(spark, d):
    o = derived.table(spark, d, "orders")
    k = F.col("o_orderkey")
    line = F.when(k % 10 == 0, F.concat(F.lit("M"), (k % 3).cast("string"), F.lit(":"))).when(k % 10 == 7, "").when(k % 10 == 5, F.concat((100 + k % 50).cast("string"), F.lit(", "), (k % 9 + 1).cast("string"), F.lit("/2,"))).otherwise((100 + k % 700).cast("string"))
    docs = o.groupBy((k - k % 500).alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))), lambda s: s["line"]), "\n").alias("text"))
    return ingest.parse_ground_truth(docs)


@query
def chunk_plan(spark, d):
    p = derived.segments(spark, d).groupBy("map_id").agg((F.max("x1") * 7).cast("long").alias("width_px"))
    return ingest.chunk_plan(p)


@query
def content_keys(spark, d):
    return derived.table(spark, d, "documents").select("doc_id", ingest.content_key(F.col("text").cast("binary")).alias("key"))


@query
def cache_misses(spark, d):
    """Documents whose content no English document has."""
    k = derived.table(spark, d, "documents").select("doc_id", "lang", ingest.content_key(F.col("text").cast("binary")).alias("key"))
    return ingest.cache_misses(k.drop("lang"), k.filter("lang = 'en'"))


@query
def pixel_coordinates(spark, d):
    s = derived.segments(spark, d)
    return s.select("map_id", "seg_id", g.to_pixels("x1", F.lit(0.5)).alias("px"), g.to_pixels("y1", F.lit(2.5)).alias("py"))


@query
def clipped_segments(spark, d):
    s = derived.segments(spark, d)
    t0, t1 = g.clip_interval("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), 100.0, 100.0, 500.0, 400.0)
    return s.select("map_id", "seg_id", F.round(t0, 6).alias("t0"), F.round(t1, 6).alias("t1")).filter("t0 < t1")


@query
def step_ranges(spark, d):
    """Ranges of the steps that some job has reached."""
    reached = derived.progress(spark, d).select("idx").distinct()
    return pr.step_ranges(pr.steps_table(spark)).join(reached, "idx", "left_semi")


@query
def progress_percent(spark, d):
    return pr.percents(derived.progress(spark, d), pr.steps_table(spark))


@query
def monotone_step(spark, d):
    return pr.monotone_steps(derived.progress(spark, d)).select("job_id", "seq", "reached")


@query
def job_ttl_expired(spark, d):
    e = derived.progress(spark, d)
    return pr.expired(e, "2024-01-30 20:00:00").select("job_id")


@query
def reading_estimates(spark, d):
    o = derived.table(spark, d, "orders")
    sec = pr.reading_estimate(F.col("o_orderkey") * 1000.0)
    return o.select("o_orderkey", F.round(sec, 6).alias("seconds"), pr.duration_text(sec).alias("shown"))


def _pages(spark, d):
    s = derived.segments(spark, d)
    return s.groupBy("map_id").agg(F.min("x1").cast("double").alias("x0"), F.min("y1").cast("double").alias("y0"), F.max("x2").cast("double").alias("x1"), F.max("y2").cast("double").alias("y1"))


@query
def frame_lines(spark, d):
    return closures.frame_lines(_pages(spark, d)).select("map_id", "layer", "x1", "y1", "x2", "y2")


@query
def endpoint_pairs(spark, d):
    """Ends of green segments within 12 of each other, whatever their degree."""
    s = derived.segments(spark, d).filter("layer = 'green'")
    e = s.select("map_id", F.col("seg_id").alias("ord"), F.col("x2").cast("double").alias("x"), F.col("y2").cast("double").alias("y"), (F.col("x2") - F.col("x1")).cast("double").alias("dx"), (F.col("y2") - F.col("y1")).cast("double").alias("dy"))
    return closures.end_pairs(e, 12.0).select("map_id", "a", "b", "d2")


@query
def greedy_match(spark, d):
    return clusters.greedy_match(endpoint_pairs(spark, d)).select("map_id", "a", "b", "d2")


@query
def route_end_lines(spark, d):
    c = closures.route_end_lines(derived.segments(spark, d).filter("layer = 'route'"), radius=150.0)
    return c.select("map_id", *[g.rounded(x, 3).alias(x) for x in ("x1", "y1", "x2", "y2")])


def _bends(spark, d):
    """A map for each customer: a route along its rectangle's first side, then up, or back across to the opposite corner."""
    r = derived.rectangles(spark, d)
    leg = lambda k, *p: F.struct(F.lit(k).cast("long").alias("seg_id"), *(F.col(c).alias(n) for c, n in zip(p, ("x1", "y1", "x2", "y2"))))
    up, back = leg(1, "x1", "y0", "x1", "y1"), leg(1, "x1", "y0", "x0", "y1")
    legs = F.array(leg(0, "x0", "y0", "x1", "y0"), F.when(F.col("face_id") % 2 == 1, up).otherwise(back))
    return r.select(F.col("face_id").alias("map_id"), F.inline(legs))


@query
def buffer_frame(spark, d):
    """Outlines of five points around routes with a right or an acute bend, mitred."""
    out = closures.buffer_outline(_bends(spark, d), 5.0, tolerance=0.01, mitre=10.0)
    return out.select("map_id", "x1", "y1", "x2", "y2")


@query
def gap_closures(spark, d):
    e = topology.noded_edges(derived.segments(spark, d).filter("layer = 'green'"))
    return closures.close_gaps(e, 5.0).select("map_id", *[F.round(x, 3).alias(x) for x in ("x1", "y1", "x2", "y2")])


@query
def map_scales(spark, d):
    """How much each map's tolerances shrink or grow with the extent of its route."""
    return strategies.scales(derived.segments(spark, d), _pages(spark, d), 500.0)


@query
def scaled_end_pairs(spark, d):
    """Ends of green segments within 12 times the map's factor of each other."""
    s = derived.segments(spark, d).filter("layer = 'green'")
    e = s.select("map_id", F.col("seg_id").alias("ord"), F.col("x2").cast("double").alias("x"), F.col("y2").cast("double").alias("y"), (F.col("x2") - F.col("x1")).cast("double").alias("dx"), (F.col("y2") - F.col("y1")).cast("double").alias("dy"))
    f = e.select("map_id").distinct().withColumn("f", (1 + F.col("map_id") / 500 % 3) / 2)
    return closures.end_pairs(e, 12.0, f).select("map_id", "a", "b", "d2")


@query
def junction_extensions(spark, d):
    """A stub on the upper side of every customer rectangle, carried on through the side."""
    sides = ring_edges(spark, d).select("map_id", (F.col("face_id") * 5 + F.col("ord")).alias("seg_id"), "x1", "y1", "x2", "y2")
    x = F.col("x0") + 20
    stubs = derived.rectangles(spark, d).select("map_id", (F.col("face_id") * 5 + 4).alias("seg_id"), x.alias("x1"), "y1", x.alias("x2"), (F.col("y1") + 0.75).alias("y2"))
    return closures.extend_junctions(topology.noded_edges(sides.unionByName(stubs))).select("map_id", *[F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def end_extensions(spark, d):
    s = derived.segments(spark, d).filter("layer = 'green'")
    return closures.extend_ends(topology.noded_edges(s), s).select("map_id", *[F.round(x, 3).alias(x) for x in ("x1", "y1", "x2", "y2")])


@query
def subdivision_faces(spark, d):
    f, _ = topology.faces(derived.segments(spark, d).filter("layer = 'green'"))
    return f.select("map_id", F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"), "n_edges")


@query
def face_length_near_route(spark, d):
    """How much of each customer rectangle's boundary lies within 5 of a horizontal route through its map."""
    lines = ring_edges(spark, d).select("map_id", "face_id", "x1", "y1", "x2", "y2")
    route = derived.rectangles(spark, d).select("map_id").distinct().select("map_id", F.lit(1).cast("long").alias("seg_id"), F.lit(-10.0).alias("x1"), F.lit(202.0).alias("y1"), F.lit(2000.0).alias("x2"), F.lit(202.0).alias("y2"))
    return faces.length_near_route(lines, route).select("map_id", "face_id", F.round("near", 6).alias("near"))


@query
def face_length_inside(spark, d):
    """How much of a horizontal route runs inside each customer rectangle, half a point from its boundary."""
    r = derived.rectangles(spark, d)
    boxes = r.select("map_id", "face_id", F.col("x0").alias("x_min"), F.col("y0").alias("y_min"), F.col("x1").alias("x_max"), F.col("y1").alias("y_max"))
    lines = ring_edges(spark, d).select("map_id", "face_id", "x1", "y1", "x2", "y2")
    route = r.select("map_id").distinct().select("map_id", F.lit(1).cast("long").alias("seg_id"), F.lit(-10.0).alias("x1"), F.lit(215.0).alias("y1"), F.lit(450.0).alias("x2"), F.lit(215.0).alias("y2"))
    return faces.length_inside(boxes, lines, route).select("map_id", "face_id", F.round("inside", 6).alias("inside"))


@query
def nearest_label(spark, d):
    s = derived.segments(spark, d)
    n = strategies.nearest_labels(derived.labels(spark, d), s.filter("layer = 'route'"), 200.0)
    return n.select("map_id", "label_ord", F.round("dist", 6).alias("dist"))


@query
def vector_verdicts(spark, d):
    return strategies.by_faces(derived.segments(spark, d), lb.load(derived.labels(spark, d)))


@query
def hybrid_crossed(spark, d):
    return strategies.hybrid(derived.segments(spark, d), lb.load(derived.labels(spark, d)), _pages(spark, d))


def _plots(spark, d):
    """The customers' rectangles as boundaries with a horizontal route through their maps, and labels among them."""
    sides = ring_edges(spark, d).select("map_id", (F.col("face_id") * 5 + F.col("ord")).alias("seg_id"), F.lit("green").alias("layer"), "x1", "y1", "x2", "y2")
    route = sides.select("map_id").distinct().select("map_id", F.lit(-1).cast("long").alias("seg_id"), F.lit("route").alias("layer"), F.lit(-10.0).alias("x1"), F.lit(215.0).alias("y1"), F.lit(450.0).alias("x2"), F.lit(215.0).alias("y2"))
    k = F.col("c_custkey").cast("long")
    labels_ = derived.table(spark, d, "customer").select((k - k % 50).alias("map_id"), k.alias("label_ord"), k.cast("string").alias("text"), ((k * 37) % 101 / 100).alias("conf"), ((k * 6007) % 1000 + 0.5).cast("double").alias("x"), ((k * 50021) % 500 + 0.25).cast("double").alias("y"))
    return sides.unionByName(route), labels_


@query
def cycle_verdicts(spark, d):
    return strategies.by_cycles(*_plots(spark, d)).select("map_id", "text", "verdict", "via", "label_ord")


@query
def region_verdicts(spark, d):
    segments, labels_ = _plots(spark, d)
    pages = segments.select("map_id").distinct().select("map_id", F.lit(1100).cast("long").alias("width"), F.lit(600).cast("long").alias("height"))
    return strategies.by_regions(segments, labels_, pages)


@query
def face_verdicts(spark, d):
    """Crossed labels of the customers' rectangles: those in a rectangle that the route runs through, the surest of each."""
    return strategies.by_faces(*_plots(spark, d)).filter("verdict = 'crossed'")


@query
def hybrid_plots(spark, d):
    """The hybrid rules on the customers' rectangles as they are: nothing snapped or closed, no road corridor."""
    segments, labels_ = _plots(spark, d)
    pages = segments.select("map_id").distinct().select("map_id", *[F.lit(v).alias(c) for v, c in ((0.0, "x0"), (0.0, "y0"), (1100.0, "x1"), (600.0, "y1"))])
    p = strategies.Params(snap=0.0, close=False, road=False)
    return strategies.hybrid(segments, labels_, pages, p=p).select("map_id", "text", "verdict", "via", "label_ord")


@query
def boundary_pixels(spark, d):
    return raster.rasterize(derived.segments(spark, d))


@query
def closed_pixels(spark, d):
    return raster.closed(derived.segments(spark, d).filter("layer = 'route'"))


@query
def background_runs(spark, d):
    """Runs of background of the rectangles' maps, whose boundaries are the rectangles' sides."""
    sides = ring_edges(spark, d).withColumn("seg_id", F.col("face_id"))
    pages = derived.rectangles(spark, d).select("map_id").distinct().select("map_id", F.lit(1000).cast("long").alias("width"), F.lit(500).cast("long").alias("height"))
    return raster.background_runs(sides, pages).select("map_id", "py", "lo", "hi")


@query
def region_sizes(spark, d):
    """Closed background regions of the rectangles' maps, thickened so that corners are tight."""
    sides = ring_edges(spark, d).withColumn("seg_id", F.col("face_id"))
    pages = derived.rectangles(spark, d).select("map_id").distinct().select("map_id", F.lit(1100).cast("long").alias("width"), F.lit(600).cast("long").alias("height"))
    return raster.sizes(sides, pages).filter("NOT touches_edge").select("map_id", "n")


@query
def kept_regions(spark, d):
    """Closed regions of 3 000 to 6 000 pixels."""
    sides = ring_edges(spark, d).withColumn("seg_id", F.col("face_id"))
    pages = derived.rectangles(spark, d).select("map_id").distinct().select("map_id", F.lit(1100).cast("long").alias("width"), F.lit(600).cast("long").alias("height"))
    return raster.kept_regions(raster.sizes(sides, pages), 3000, 6000).select("map_id", "n")


def _sheets(spark, d):
    """Pages of 1 000 by 600 pixels for the maps of the orders."""
    maps = derived.segments(spark, d).select("map_id").distinct()
    return maps.select("map_id", F.lit(1000).cast("long").alias("width"), F.lit(600).cast("long").alias("height"))


@query
def background_fill(spark, d):
    """Runs of background farther than ten pixels from all green lines."""
    green = derived.segments(spark, d).filter("layer = 'green'")
    return raster.far_runs(green, _sheets(spark, d), 10.0)


@query
def filled_background(spark, d):
    """What is left of the background once its far parts are filled."""
    green = derived.segments(spark, d).filter("layer = 'green'")
    return raster.filled_runs(green, _sheets(spark, d), 10.0).select("map_id", "py", "lo", "hi")


@query
def label_clearance(spark, d):
    """Squared distance of every label's pixel from the nearest green pixel, up to twelve."""
    green = derived.segments(spark, d).filter("layer = 'green'")
    dots = derived.labels(spark, d).select("map_id", "label_ord", F.floor("x").alias("px"), F.floor("y").alias("py"))
    return raster.clearances(dots, green, _sheets(spark, d), "label_ord", 12.0)


@query
def annotation_rows(spark, d):
    l_ = lb.load(derived.labels(spark, d))
    return strategies.annotations(strategies.by_rays(derived.segments(spark, d), l_), l_)


@query
def green_in_route_buffer(spark, d):
    return crossing.crossed_greens(derived.segments(spark, d), buffer=2.5).select("map_id", "seg_id")


@query
def label_filter_plain(spark, d):
    return lb.load_plain(derived.labels(spark, d)).select("map_id", "label_ord", "text", "conf")


@query
def label_filter_sure(spark, d):
    return lb.load_sure(derived.labels(spark, d)).select("map_id", "label_ord", "text", "conf")


@query
def place_along_route(spark, d):
    s = lb.along_route(derived.labels(spark, d), derived.segments(spark, d).filter("layer = 'route'"))
    return s.select("map_id", "label_ord", F.round("s", 4).alias("s"))


@query
def face_centroids(spark, d):
    c = faces.centroids(ring_edges(spark, d))
    return c.select("map_id", "face_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query
def parallel_pairs(spark, d):
    """Ends of parallel green segments whose joint is square to both."""
    s = derived.segments(spark, d).filter("layer = 'green' AND (x1 <> x2 OR y1 <> y2)")
    n = g.length()
    e = s.select("map_id", F.col("seg_id").alias("ord"), F.col("x2").cast("double").alias("x"), F.col("y2").cast("double").alias("y"), ((F.col("x2") - F.col("x1")) / n).alias("dx"), ((F.col("y2") - F.col("y1")) / n).alias("dy"))
    return closures.square_pairs(e, 60.0).select("map_id", "a", "b", "d2")


@query
def tangent_crosslines(spark, d):
    """Lines square to the route at the starts of its segments."""
    route = derived.segments(spark, d).filter("layer = 'route'")
    at = route.select("map_id", F.col("seg_id").alias("ord"), F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y"))
    t = closures.tangents(at, route, 150.0)
    return t.select("map_id", "ord", g.rounded(F.col("x") + 25 * F.sin(F.radians("axis")), 3).alias("x1"), g.rounded(F.col("y") - 25 * F.cos(F.radians("axis")), 3).alias("y1"))


@query
def corridor_long_lines(spark, d):
    """The rectangles' sides of 60 or more, as the corridor's candidates."""
    lines = corridor.long_lines(ring_edges(spark, d).withColumn("seg_id", F.col("face_id") * 4 + F.col("ord")), 60.0)
    return lines.select("map_id", "x1", "y1", "x2", "y2")


@query
def corridor_lines(spark, d):
    s = derived.segments(spark, d)
    c = corridor.corridor_lines(s.filter("layer = 'green'"), s.filter("layer = 'route'"), least=20.0, sure=25.0)
    return c.select("map_id", "side", *[F.round(x, 3).alias(x) for x in ("x1", "y1", "x2", "y2")])


def _road(spark, d):
    """A corridor for every map of rectangles: a band from y = 195 to y = 305."""
    corner = lambda i, x, y: F.struct(F.lit(i).alias("ord"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    maps = derived.rectangles(spark, d).select("map_id").distinct()
    band = maps.select("map_id", F.lit("corridor").alias("face_id"), F.inline(F.array(corner(0, -5.0, 195.0), corner(1, 620.0, 195.0), corner(2, 620.0, 305.0), corner(3, -5.0, 305.0))))
    return clusters.ring_edges(band, ["map_id", "face_id"]).select("map_id", "face_id", F.lit("shell").alias("ring"), "x1", "y1", "x2", "y2")


@query
def corridor_shares(spark, d):
    """The part of each rectangle's area in the band, where there is any."""
    e = ring_edges(spark, d).select("map_id", "face_id", F.lit("shell").alias("ring"), "x1", "y1", "x2", "y2")
    return corridor.shared_areas(e, _road(spark, d)).select("map_id", "face_id", F.round("shared", 3).alias("shared"))


@query
def corridor_faces(spark, d):
    """The rectangles that lie mostly in the band."""
    e = ring_edges(spark, d).select("map_id", "face_id", F.lit("shell").alias("ring"), "x1", "y1", "x2", "y2")
    return corridor.corridor_faces(face_area(spark, d), e, _road(spark, d))


@query
def corridor_labels(spark, d):
    return corridor.corridor_labels(_plots(spark, d)[1], _road(spark, d))


@query
def log_line_steps(spark, d):
    """Lines of the log, made of the orders' keys, and their steps."""
    k = F.col("o_orderkey")
    starts = F.array(*[F.lit(p.strip("^").replace("[0-9]+", "7")) for p, _ in pr.LOG_STEPS], F.lit("other"), F.lit("x paths:"))
    lines = derived.table(spark, d, "orders").select(k, F.concat(F.get(starts, (k % 18).cast("int")), F.lit(" "), k.cast("string")).alias("line"))
    return lines.select("o_orderkey", "line", pr.step_of_line().alias("step"))


@query
def cancelled_events(spark, d):
    """Each job is asked to stop at its fifth event's time."""
    e = derived.progress(spark, d)
    w = Window.partitionBy("job_id").orderBy("seq")
    asked = e.withColumn("n", F.row_number().over(w)).filter("n = 5").select("job_id", "ts")
    return pr.until_cancelled(e, asked).select("job_id", "seq", "cancelled")


@query
def job_messages(spark, d):
    """What clients are told: every fiftieth event is an error, every second job is asked to stop at its fifth event's time."""
    kind = F.when(F.col("seq") % 50 == 0, "error").otherwise("step")
    e = derived.progress(spark, d).withColumn("kind", kind)
    w = Window.partitionBy("job_id").orderBy("seq")
    asked = e.filter("job_id % 2 = 0").withColumn("n", F.row_number().over(w)).filter("n = 5").select("job_id", "ts")
    return jobs.job_messages(e, asked)


@query
def inbox_pages(spark, d):
    """The documents' texts as pages that arrive in a stream: each content once, written by batch."""
    base = f"{shared_folder(spark)}/inbox-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    texts = spark.readStream.schema(schema).parquet(f"{d}/[d]ocuments.parquet")  # a pattern, as the table may be one file
    pages = texts.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    inbox.deliver(inbox.new_pages(pages), f"{base}/pages", f"{base}/checkpoint", availableNow=True).awaitTermination()
    return inbox.delivered(spark, f"{base}/pages", "path string, key string, length long").select("key", "length")


@query
def keepalive_events(spark, d):
    """A keepalive for every day of silence between a job's events."""
    return pr.keepalives(derived.progress(spark, d), 3600 * 24).select("job_id", "seq", "k", F.unix_timestamp("ts").alias("alive_at"))


@query
def variant_totals(spark, d):
    found, truth = _found_and_truth(spark, d)
    a = evaluation.outcomes(found, truth).withColumn("variant", F.lit("A"))
    b = evaluation.outcomes(truth, truth).withColumn("variant", F.lit("B"))
    each = truth.groupBy("map_id").agg((F.count("*") * 0.25).alias("seconds"))
    timings = each.withColumn("variant", F.lit("A")).unionByName(each.withColumn("variant", F.lit("B")))
    return evaluation.totals(a.unionByName(b), timings, found)
