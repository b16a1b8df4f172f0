"""Hand-computed cases of the map operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoweave.functions import colors
from geoweave.functions import geometry as g
from geoweave.functions import labels as fl
from geoweave.operators import closures, clusters, corridor, crossing, directions, faces, intervals, rays, topology
from geoweave.operators import labels as lb
from geoweave.plans import strategies
from geoweave.sources import ingest
from geoweave.streaming import progress as pr

SEG = "map_id long, seg_id long, layer string, x1 double, y1 double, x2 double, y2 double"


def segs(spark, rows, layer="green"):
    return spark.createDataFrame([(0, i, r[0] if isinstance(r[0], str) else layer, *map(float, r[-4:])) for i, r in enumerate(rows)], SEG)


def square(a, b, c, d):
    return [(a, b, c, b), (c, b, c, d), (c, d, a, d), (a, d, a, b)]


def route(*r):
    return [("route", *r)]


def labels(spark, *rows):
    return spark.createDataFrame([(0, i, t, 1.0, float(x), float(y)) for i, (t, x, y) in enumerate(rows)], "map_id long, label_ord long, text string, conf double, x double, y double")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("rgb,green,strict,red", [((0, 0.584, 0), True, True, False), ((0.05, 0.6, 0.05), True, True, False), ((0, 0.2, 0), False, False, False), (None, False, False, False), ((1, 0, 0), False, False, True), ((0.98, 0.02, 0.01), False, False, True), ((0.9, 0.4, 0.4), False, False, False)])
def test_colors(spark, rgb, green, strict, red):
    df = spark.createDataFrame([(tuple(map(float, rgb)) if rgb else None,)], "color struct<r:double,g:double,b:double>")
    assert tuple(df.select(colors.is_green(), colors.is_strict_green(), colors.is_red()).first()) == (green, strict, red)


def test_number_pattern(spark):
    good = ["391", "336", "296/3", "48/1", "1", "99/99"]
    bad = ["", "abc", "296/", "/3", "3/3/3", "12.3", "strona 3", "2024", "7283", "1315/16", "391abc"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", fl.valid(F.col("t"), fl.BUILDER).alias("v")).collect()}
    assert all(got[t] for t in good) and not any(got[t] for t in bad)


def test_repairs(spark):
    want = {"7260": "260", "0614/1": "614/1", "6052": "605/2", "7236743": "236/43", "557/": "557", "12345": "123/45", "7283": "283", "7012": "012", "236143": "236/43", "7": "7", "": "", "/": "/", "x7": "x7"}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", fl.repair("t").alias("v")).collect()} == want


def test_angles_and_pixels(spark):
    assert value(spark, g.undirected_angle(F.lit(-1.0), F.lit(-1.0))) == pytest.approx(45)
    assert value(spark, g.angle_between(F.lit(175.0), F.lit(5.0))) == pytest.approx(10)
    assert value(spark, g.to_pixels(F.lit(5), F.lit(0.5))) == 2  # halves go to the even pixel
    assert value(spark, g.clamp(F.lit(7.0), 0, 5)) == 5


def test_polygonize(spark):
    f, e = topology.faces(segs(spark, square(0, 0, 10, 10) + square(20, 0, 30, 10)))
    assert sorted(r["area"] for r in f.collect()) == [100, 100] and e.count() == 8
    gap = [(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 1)]
    assert topology.faces(segs(spark, gap))[0].count() == 0
    assert topology.faces(segs(spark, gap), 2.0)[0].count() == 1


def test_holes_dangles_and_bridges(spark):
    lines = square(0, 0, 20, 20) + square(5, 5, 10, 10) + [(0, 10, -5, 10), (12, 12, 15, 15), (10, 10, 20, 20)]
    f, _ = topology.faces(segs(spark, lines[:-1]))
    assert sorted(r["area"] for r in f.collect()) == [25, 375]
    f, _ = topology.faces(segs(spark, lines))  # a bridge changes no area
    assert sorted(r["area"] for r in f.collect()) == [25, 375]


def test_euler_and_total_area(spark):
    rng = random.Random(5)
    lines = square(0, 0, 100, 100) + [(rng.uniform(-10, 110), rng.uniform(-10, 110), rng.uniform(-10, 110), rng.uniform(-10, 110)) for _ in range(14)]
    s = segs(spark, lines)
    f, _ = topology.faces(s)
    inner = topology.faces(segs(spark, square(0, 0, 100, 100) + [r for r in lines[4:]]))[0]
    assert f.agg(F.sum("area")).first()[0] >= 100 * 100 - 1 and inner.count() == f.count()
    edges = topology.noded_edges(s)
    links = edges.select("u", "v").collect()
    nodes = {n for r in links for n in r}
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[find(u)] = find(v)
    assert len(nodes) - len(links) + f.count() == len({find(n) for n in nodes})
    moved = segs(spark, [(a + 7, b - 3, c + 7, d - 3) for a, b, c, d in lines])
    assert sorted(round(r["area"], 1) for r in topology.faces(moved)[0].collect()) == pytest.approx(sorted(round(r["area"], 1) for r in f.collect()), abs=0.2)


def test_point_in_ring_excludes_the_boundary(spark):
    lines = segs(spark, square(0, 0, 10, 10)).withColumn("face_id", F.lit("f"))
    pts = spark.createDataFrame([(0, 1, 5.0, 5.0), (0, 2, 0.0, 5.0), (0, 3, 10.0, 10.0), (0, 4, 11.0, 5.0), (0, 5, 5.0, 9.99)], "map_id long, p long, x double, y double")
    assert sorted(r["p"] for r in topology.points_in_rings(pts, lines, "p", "face_id").collect()) == [1, 5]


P = strategies.Params


@pytest.mark.parametrize("rows,label,params,want", [
    (square(0, 0, 10, 10) + route(-5, 5, 15, 5), ("100", 5, 5), P(snap=0.1, corridor=20, face_band=1), "crossed"),
    (square(0, 0, 10, 10) + route(0, -0.3, 10, -0.3), ("101", 5, 5), P(snap=0.1, corridor=20, face_band=1), "borderline"),
    (square(0, 0, 10, 10) + route(30, 0, 60, 0), ("302", 45, 2), P(snap=0.1, corridor=10), "borderline"),
    (square(0, 0, 10, 10) + route(30, 0, 60, 0), ("303", 500, 500), P(snap=0.1, corridor=10, endpoint=10), None),
    (square(0, 0, 10, 10) + route(0, 0, 100, 0), ("284", 300, 10), P(snap=0.1, corridor=10, endpoint=250), "borderline"),
])
def test_face_strategy(spark, rows, label, params, want):
    got = strategies.by_faces(segs(spark, rows), labels(spark, label), params).collect()
    assert [r["verdict"] for r in got] == ([want] if want else [])


def test_hybrid_strategy(spark):
    rows = square(0, 0, 100, 100) + square(100, 0, 200, 100) + square(400, 400, 500, 500) + route(20, 50, 180, 50)
    maps = spark.createDataFrame([(0, -50.0, -50.0, 600.0, 600.0)], "map_id long, x0 double, y0 double, x1 double, y1 double")
    got = strategies.hybrid(segs(spark, rows), labels(spark, ("11", 50, 20), ("12", 150, 80), ("13", 450, 450)), maps, p=P(buffer=2.0, extension=1.0, parallel=1.0, junction=1.0)).collect()
    verdict = {r["text"]: r["verdict"] for r in got}
    assert verdict["11"] == verdict["12"] == "crossed" and verdict.get("13") != "crossed"


ROAD = [(0, 0, 300, 0), (0, 60, 300, 60), *((x, 0, x, 60) for x in (0, 100, 200, 300)), *square(0, 60, 100, 200)]


def test_road_corridor(spark):
    s = segs(spark, ROAD + route(150, 30, 150, 100))
    green, red = s.filter("layer = 'green'"), s.filter("layer = 'route'")
    ring = corridor.corridors(green, red)
    assert {(r["x1"], r["y1"]) for r in ring.collect()} >= {(-4, -4), (304, -4), (304, 64), (-4, 64)}
    assert corridor.route_share(ring, red).first()["share"] == pytest.approx(34 / 70, abs=1e-3)
    f, e = topology.faces(green)
    found = corridor.corridor_faces(f, e, ring).join(f, ["map_id", "face_id"])
    assert sorted(r["area"] for r in found.collect()) == [6000] * 3  # the plot above has 400 of its 14 000 in it
    assert [r["label_ord"] for r in corridor.corridor_labels(labels(spark, ("1", 150, 30), ("2", 50, 150)), ring).collect()] == [0]
    assert corridor.used_corridors(green, red).count() == ring.count()
    assert corridor.used_corridors(green, segs(spark, route(150, 10, 150, 50))).count() == 0  # the route lies in it whole
    assert corridor.corridors(segs(spark, ROAD[:1]), red).count() == 0


def test_hybrid_uses_the_corridor(spark):
    """A parcel of the road that the route does not touch is crossed, its neighbour beside the road is not."""
    maps = spark.createDataFrame([(0, -50.0, -50.0, 600.0, 600.0)], "map_id long, x0 double, y0 double, x1 double, y1 double")
    s = segs(spark, ROAD + [(100, 200, 300, 200), (300, 200, 300, 60)] + route(150, 30, 150, 100))
    found = labels(spark, ("11", 50, 30), ("12", 250, 30), ("13", 50, 150)).withColumn("conf", F.lit(0.5) + F.col("label_ord") / 10)
    got = strategies.hybrid(s, found, maps, p=P(buffer=2.0, extension=1.0, parallel=1.0, junction=1.0)).collect()
    verdict = {r["text"]: (r["verdict"], r["label_ord"]) for r in got}
    assert verdict["11"] == ("crossed", 0) and verdict["12"] == ("crossed", 1) and "13" not in verdict


def test_rays_only_from_large_faces(spark):
    """Labels in a face of ray_face or more, at a middle distance from the buffered route."""
    s = segs(spark, square(0, 0, 1000, 1000) + square(100, 300, 140, 340) + route(0, 100, 1000, 100))
    f, e = topology.faces(s.filter("layer = 'green'"))
    free = labels(spark, ("a", 500, 250), ("b", 500, 120), ("c", 500, 900), ("d", 120, 320), ("e", 500, 187), ("f", 500, 186.9), ("g", 500, 302), ("h", 500, 302.1))
    got = strategies.ray_gate(free, f, e, s.filter("layer = 'route'"), P())
    assert sorted(r["text"] for r in got.collect()) == ["a", "e", "g"]
    assert len({(round(x, 6), round(y, 6)) for x, y in rays.around(72, 110.0)}) == 72


def test_route_strips(spark):
    s = segs(spark, [(0, 1.9, 10, 1.9), (0, 2.1, 10, 2.1), (-5, 0, -1, 0), (5, -9, 5, 9), (9, 3, 14, -3), (11, 3, 14, -3)] + route(0, 0, 10, 0))
    assert sorted(r["seg_id"] for r in crossing.crossed_greens(s, buffer=2.0).collect()) == [0, 3, 4]


def test_chains_along_both_axes(spark):
    rng = random.Random(8)
    rows = [(0, i, f"t{i % 5}", rng.random(), rng.uniform(0, 400), rng.uniform(0, 400), "easy") for i in range(300)]
    df = spark.createDataFrame(rows, "map_id long, ord long, text string, conf double, x double, y double, source string")
    for near, fold in ((20.0, lb.positional_dedup), (30.0, lb.merge_passes)):
        c = {r["ord"]: r["chain"] for r in lb.chains(df, near).collect()}
        assert all(c[a[1]] == c[b[1]] for a in rows for b in rows if abs(a[4] - b[4]) < near and abs(a[5] - b[5]) < near)
        one = {r["ord"]: r for r in fold(df).collect()}
        assert 0 < len(one) <= 300


def test_closing_and_built_readings(spark):
    from geoweave.operators import raster

    px = spark.createDataFrame([(0, x, y) for x in (0, 1, 2, 5, 6, 20) for y in range(-3, 4)], "map_id long, px long, py long")
    assert sorted(r["px"] for r in raster.closed(px, 2).filter("py = 0").collect()) == [0, 1, 2, 3, 4, 5, 6, 20]
    shape = "map_id long, ord long, text string, conf double, x double, y double, source string"
    a = spark.createDataFrame([(0, 1, "7260", 0.9, 0.0, 0.0, "easy"), (0, 2, "31", 0.4, 100.0, 0.0, "easy")], shape)
    b = spark.createDataFrame([(0, 3, "31", 0.8, 103.0, 0.0, "easy")], shape)
    t = spark.createDataFrame([(0, 4, "55", 0.9, 300.0, 0.0, "tess"), (0, 5, "56", 0.9, 101.0, 1.0, "tess")], shape)
    assert sorted((r["text"], r["conf"]) for r in lb.build([a, b], t).collect()) == [("260", 0.9), ("31", 0.8), ("55", 0.9)]


def test_shared_folder_is_required_on_clusters():
    from types import SimpleNamespace

    from geoweave import scratch

    session = lambda master, named=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: named), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda *a: None)))
    with pytest.raises(ValueError):
        scratch.shared_folder(session("spark://host:7077"))
    with pytest.raises(ValueError):
        scratch.shared_folder(session("local-cluster[2,1,1024]"))
    assert scratch.shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"


def test_scopes_remove_their_tables(spark):
    import os

    from geoweave import scratch

    where = lambda t: t.scratch_path.removeprefix("file://")
    with scratch.scope(spark):
        inner, kept = scratch.materialize(spark.range(3), "inner"), scratch.materialize(spark.range(4), "kept", outside=True)
        assert os.path.isdir(where(inner)) and inner.count() == 3
    assert not os.path.exists(where(inner)) and kept.count() == 4
    scratch.forget(kept)
    assert not os.path.exists(where(kept))


def test_closest_duplicate(spark):
    df = labels(spark, ("280", 50, 5), ("280", 50, 500)).withColumn("dist", F.col("y"))
    r = lb.closest_per_text(df).collect()
    assert len(r) == 1 and r[0]["y"] == 5


def test_intervals(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0, 5.0, 1.0, 5.0, 9.0), (0.0, 0.0, 10.0, 0.0, 2.0, 0.5, 6.0, 0.5), (0.0, 0.0, 10.0, 0.0, 0.0, 50.0, 9.0, 50.0)], "a double,b double,c double,d double,e double,f double,g double,h double")
    pair = lambda *n: F.struct(*[F.col(x).alias(y) for x, y in zip(n, ("x1", "y1", "x2", "y2"))])
    pairs = df.select("b", "f", pair(*"abcd").alias("l"), pair(*"efgh").alias("r"))
    got = sorted(intervals.near_parts(pairs, [F.col("f")], "l", "r", 2.0).collect(), key=lambda r: {1.0: 0, 0.5: 1, 50.0: 2}[r["f"]])
    w = math.sqrt(3) / 10
    assert (got[0]["t0"], got[0]["t1"]) == pytest.approx((0.5 - w, 0.5 + w))
    w = math.sqrt(4 - 0.25) / 10
    assert (got[1]["t0"], got[1]["t1"]) == pytest.approx((0.2 - w, 0.6 + w))
    assert (got[2]["t0"], got[2]["t1"]) == (-1, -1)
    parts = spark.createDataFrame([("a", 0.1, 0.3), ("a", 0.2, 0.4), ("a", 0.6, 0.7), ("a", 0.65, 0.66)], "k string, t0 double, t1 double")
    assert intervals.union_length(parts, ["k"]).first()["share"] == pytest.approx(0.4)
    assert [(r["t0"], r["t1"]) for r in intervals.gaps(parts, ["k"]).orderBy("t0").collect()] == [(0, 0.1), (0.4, 0.6), (0.7, 1)]


def test_hulls(spark):
    lines = segs(spark, [(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 5, 5), (5, 5, 0, 10), (0, 10, 0, 0)]).withColumn("face_id", F.lit("f"))
    assert faces.hull_areas(lines).first()["hull"] == 100


def test_gap_and_junction_closures(spark):
    e = topology.noded_edges(segs(spark, [(0, 0, 10, 0), (13, 0, 30, 0), (100, 0, 110, 0)]))
    got = closures.close_gaps(e).collect()
    assert [(r["x1"], r["x2"]) for r in got] in ([(10, 13)], [(13, 10)])
    t = topology.noded_edges(segs(spark, [(0, 0, 20, 0), (10, 0, 10, 15)]))
    r = closures.extend_junctions(t).first()
    assert (r["x1"], r["y1"], r["x2"], r["y2"]) == (10, 0, 10, -40)
    s = segs(spark, [(0, 0, 10, 0), (50, -5, 50, 5)])
    ext = [(r["x1"], r["x2"]) for r in closures.extend_ends(topology.noded_edges(s), s).collect()]
    assert (10, 50) in ext


def test_buffer_frame_is_closed(spark):
    out = closures.buffer_frame(segs(spark, [(0, 0, 100, 0)], "route"), 10.0)
    f, _ = topology.faces(out)
    assert [round(r["area"]) for r in f.collect()] == [2000]


def test_greedy_match_equals_the_scan(spark):
    rng = random.Random(3)
    pairs = [(0, a, b, float(rng.randint(1, 9))) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.3]
    used, want = set(), set()
    for _, a, b, d in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    got = clusters.greedy_match(spark.createDataFrame(pairs, "map_id long, a long, b long, d2 double"))
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_near_route(spark):
    s = segs(spark, [(0, 3, 10, 3), (0, 8, 10, 8)])
    assert [r["seg_id"] for r in crossing.near_route(s, segs(spark, [(0, 0, 10, 0)], "route"), 5.0).collect()] == [0]


def test_oriented_sum(spark):
    d = directions.oriented_sum(segs(spark, [(0, 0, 3, 4), (3, 4, 0, 0)]), ["map_id"]).first()
    assert (d["ux"], d["uy"]) == pytest.approx((0.6, 0.8))


def test_ground_truth(spark):
    df = spark.createDataFrame([(1, "A:\n1, 2/3\n 4 \n\n9\nB:\n5,,5")], "doc long, text string")
    assert sorted((r["map_name"], r["text"]) for r in ingest.parse_ground_truth(df).collect()) == [("A", "1"), ("A", "2/3"), ("A", "4"), ("B", "5")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"abc")
    assert [r["key"] for r in ingest.list_pages(spark, str(tmp_path)).collect()] == ["ba7816bf8f01cfea414140de"]
    (tmp_path / "gt.txt").write_text("12/3\n\n 4 \n4\n")
    assert sorted(r["text"] for r in ingest.read_flat_truth(spark, str(tmp_path / "gt.txt")).collect()) == ["12/3", "4"]
    raw = spark.createDataFrame([("m", 1, "12", 0.9, None, None, 40.0, 80.0, None, "easy"), ("m", 2, "13", 0.9, 1.0, 2.0, None, None, None, "easy"), ("m", 3, "14", 0.9, None, None, None, None, [(0.0, 0.0), (8.0, 0.0), (8.0, 16.0), (0.0, 16.0)], "tess")], ingest.OCR_RAW)
    raw.write.parquet(str(tmp_path / "ocr"))
    assert [(r["x"], r["y"]) for r in ingest.read_ocr(spark, str(tmp_path / "ocr"), 8.0).orderBy("ord").collect()] == [(5, 10), (1, 2), (0.5, 1)]
    assert ingest.read_drawings(spark, str(tmp_path / "ocr")).columns[0] == "map_id"


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = [(j, s, pr.STEPS[(s * 5 + j) % 9][0], (s * 5 + j) % 9, s % 3 == 0) for j in range(4) for s in range(12)]
    df = spark.createDataFrame(rows, "job_id long, seq long, step string, idx int, complete boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pr.progress_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["job_id"], r["seq"]): r["percent"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["job_id"], r["seq"]): r["percent"] for r in pr.percents(df, pr.steps_table(spark)).collect()}
    assert got == want


def test_sse_lines_and_ticker(spark):
    r = pr.sse_lines(spark.createDataFrame([(1, 2, "render")], "job_id long, seq long, step string")).first()
    assert r["line"] == 'data: {"seq":2,"step":"render"}\n\n'
    assert value(spark, pr.ticker(F.lit(10.0), F.lit(30.0), F.lit(5.0), F.lit(10.0))) == pytest.approx(19.5)


def test_radius_clusters_equal_the_scan_in_order(spark):
    rng = random.Random(5)
    rows = [(m, i, float(rng.randrange(60)), float(rng.randrange(40)), rng.uniform(-1, 1), rng.uniform(-1, 1)) for m in (1, 2) for i in range(90)]
    rows += [(3, i, 3.0 * i, 0.0, 1.0, 0.0) for i in range(60)]  # one after the other, in order
    want = set()
    for m in (1, 2, 3):
        seeds: list = []
        for _, i, x, y, dx, dy in (r for r in rows if r[0] == m):
            at = next((s for s in seeds if math.hypot(s[0] - x, s[1] - y) <= 7), None)
            if at is None:
                at = (x, y, dx, dy, [])
                seeds.append(at)
            flip = -1 if dx * at[2] + dy * at[3] < 0 else 1
            at[4].append((x, y, flip * dx, flip * dy))
        for k, s in enumerate(seeds):
            n = len(s[4])
            want.add((m, k + 1, n, *(round(sum(p[c] for p in s[4]) / (n if c < 2 else 1), 6) for c in range(4))))
    got = clusters.radius_clusters(spark.createDataFrame(rows, "map_id long, ord long, x double, y double, dx double, dy double"), 7.0)
    assert {(r.map_id, r.cluster, r.n, *(round(v, 6) for v in (r.x, r.y, r.dx, r.dy))) for r in got.collect()} == want
    assert clusters.radius_clusters(spark.createDataFrame([], "map_id long, ord long, x double, y double, dx double, dy double"), 7.0).count() == 0
