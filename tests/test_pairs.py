"""Measures of pairs of segments with numpy, against the same formulas as columns and by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.functions import geometry as g
from geoweave.operators import closures, corridor, crossing, faces, pairs, topology

SEG = "map_id long, seg_id long, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def some(spark):
    """Pairs of segments with whole coordinates in a small field, so that many touch, cross and lie along each other."""
    rng = random.Random(3)
    rows = []
    while len(rows) < 600:
        p = [float(rng.randrange(7)) for _ in range(8)]
        if p[:2] != p[2:4] and p[4:6] != p[6:]:
            rows.append((len(rows), tuple(p[:4]), tuple(p[4:])))
    seg = "struct<x1: double, y1: double, x2: double, y2: double>"
    return spark.createDataFrame(rows, f"k long, l {seg}, r {seg}")


def test_pairs_as_columns(some):
    everyone = lambda f: lambda *c: (np.arange(len(c[0])), [f(*c).astype(float)])
    cases = [
        (pairs.meet, g.segments_meet("l", "r").cast("double")),
        (pairs.distance, g.segment_distance("l", "r")),
        (lambda *c: pairs.meet_strip(*c, np.full(len(c[0]), 1.5)), (g.segments_meet("l", "r") | g.meets_strip("l", "r", F.lit(1.5))).cast("double")),
    ]
    for run, column in cases:
        got = {r["k"]: r["v"] for r in pairs.measured(some, [F.col("k")], "l", "r", ("v",), everyone(run)).collect()}
        assert got == pytest.approx({r["k"]: r["v"] for r in some.select("k", column.alias("v")).collect()})


def test_cuts_of_a_pair(spark):
    """A crossing cuts both, a touch only the one that goes on, segments along each other are cut at each other's ends."""
    rows = [(0, 0, 0, 4, 0, 1, -1, 1, 1), (1, 0, 0, 4, 0, 2, 0, 2, 5), (2, 0, 0, 4, 0, 1, 0, 8, 0), (3, 0, 0, 4, 0, 0, 1, 4, 1), (4, 0, 0, 4, 0, 1, 0, 3, 0)]
    df = spark.createDataFrame([(k, tuple(map(float, p[:4])), tuple(map(float, p[4:]))) for k, *p in rows], "k long, l struct<x1: double, y1: double, x2: double, y2: double>, r struct<x1: double, y1: double, x2: double, y2: double>")
    got = pairs.measured(df, [F.col("k")], "l", "r", ("second", "x1", "y1", "x2", "y2", "t"), pairs.cuts).collect()
    assert sorted((r["k"], r["second"], round(r["t"], 9)) for r in got) == [(0, 0, 0.25), (0, 1, 0.5), (1, 0, 0.5), (2, 0, 0.25), (2, 1, round(3 / 7, 9)), (4, 0, 0.25), (4, 0, 0.75)]


def conditions(df):
    return [row for row in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in row]


def test_joins_compare_boxes_only(spark):
    """What is told of a pair by more than its boxes is not in the condition of a join, where each pair would be interpreted."""
    rows = [(0, i, *map(float, r)) for i, r in enumerate([(0, 0, 10, 10), (0, 10, 10, 0), (5, 0, 5, 10)])]
    s = spark.createDataFrame(rows, SEG)
    layers = s.withColumn("layer", F.when(F.col("seg_id") == 0, "route").otherwise("green"))
    edges = topology.edge_coordinates(topology.noded_edges(s)).withColumn("face_id", F.lit("a"))
    made = [topology.noded_edges(s), crossing.crossed_greens(layers, buffer=2.0), faces.edge_route_pairs(edges, s, 2.0), closures.extend_ends(topology.noded_edges(s), s)]
    for df in made:
        assert conditions(df) and not any("SIGNUM" in c.upper() or "SQRT" in c.upper() or "HYPOT" in c.upper() for c in conditions(df))


def test_holes_are_found_once(spark, monkeypatch):
    """Faces and their edges read the holes from one table, and free ends are one before their rays are dealt to cells."""
    made = []
    plain = topology.materialize
    watched = lambda df, name, *more, **kinds: made.append(name) or plain(df, name, *more, **kinds)
    monkeypatch.setattr(topology, "materialize", watched)
    monkeypatch.setattr(closures, "materialize", watched)
    square = lambda a, b: [(a, a, b, a), (b, a, b, b), (b, b, a, b), (a, b, a, a)]
    s = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(square(0, 10) + square(3, 5))], SEG)
    f, e = topology.faces(s)
    assert sorted(r["area"] for r in f.collect()) == [4, 96] and e.filter("ring = 'hole'").count() == 4
    assert made.count("holes") == 1
    stub = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 0.0), (0, 2, 20.0, -5.0, 20.0, 5.0)], SEG)
    got = closures.extend_ends(topology.noded_edges(stub), stub).collect()
    assert [(r["x1"], r["x2"]) for r in got] == [(10.0, 20.0)] and made.count("ends") == 1


def test_without_a_corridor_none_is_measured(spark, monkeypatch):
    """No map has lines along its route: the route's share of a corridor is not worked out, over no rows."""
    monkeypatch.setattr(corridor, "route_share", None)
    s = spark.createDataFrame([(0, 1, 0.0, 0.0, 3.0, 0.0)], SEG)
    route = spark.createDataFrame([(0, 2, 0.0, 1.0, 3.0, 1.0)], SEG)
    assert corridor.used_corridors(s, route).count() == 0
