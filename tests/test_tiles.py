"""Bands of lines against pixels tried one by one, on segments that pass several bands and leave their pages."""

import random

import pytest
from pyspark.sql import functions as F

from geoweave.operators import raster, tiles
from geoweave.plans import strategies
from geoweave.scratch import materialize

SEG = "map_id long, seg_id long, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture()
def drawn(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BAND", 16)
    rng = random.Random(5)
    rows = [(m, i, *(float(rng.randrange(-8, 70)) for _ in range(4))) for m in range(2) for i in range(7)]
    rows += [(0, 90, 3.0, 4.0, 3.0, 4.0), (0, 91, 5.0, 40.0, 12.0, 40.0), (1, 92, 30.0, 60.0, 30.0, 2.0), (3, 93, 0.0, 0.0, 9.0, 9.0)]
    segments = spark.createDataFrame(rows, SEG)
    pages = spark.createDataFrame([(0, 60, 50), (1, 45, 61), (2, 5, 20)], "map_id long, width long, height long")
    pixels = {(r["map_id"], r["px"], r["py"]) for r in raster.rasterize(segments).collect()}
    return segments, pages, pixels, {0: (60, 50), 1: (45, 61), 2: (5, 20)}


def filled(rows):
    out = [(r["map_id"], x, r["py"]) for r in rows for x in range(r["lo"], r["hi"] + 1)]
    assert len(out) == len(set(out))
    return set(out)


def test_closing_of_segments(spark, drawn):
    segments, _, pixels, _ = drawn
    disc = raster.disc(2)
    thick = {(m, x + dx, y + dy) for m, x, y in pixels for dx, dy in disc}
    want = {(m, x, y) for m, x, y in {(m, x + dx, y + dy) for m, x, y in thick for dx, dy in disc} if all((m, x + dx, y + dy) in thick for dx, dy in disc)}
    got = [tuple(r) for r in raster.closed(segments, 2).select("map_id", "px", "py").collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("reach", [4.0, 3.5])
def test_background_and_distances_of_segments(spark, drawn, reach):
    segments, pages, pixels, sizes = drawn
    on = {m: [(x, y) for k, x, y in pixels if k == m and 0 <= x < w and 0 <= y < h] for m, (w, h) in sizes.items()}
    d2 = {(m, x, y): min(((x - a) ** 2 + (y - b) ** 2 for a, b in on[m]), default=10**9) for m, (w, h) in sizes.items() for x in range(w) for y in range(h)}
    assert filled(raster.background_runs(segments, pages).collect()) == {p for p, d in d2.items() if d}
    assert filled(raster.far_runs(segments, pages, reach).collect()) == {p for p, d in d2.items() if d > reach * reach}
    assert filled(raster.filled_runs(segments, pages, reach).collect()) == {p for p, d in d2.items() if 0 < d <= reach * reach}
    asked = spark.createDataFrame([(m, 1000 * x + y, x, y) for m, x, y in d2], "map_id long, dot long, px long, py long")
    got = {(r["map_id"], r["dot"]): r["d2"] for r in raster.clearances(asked, segments, pages, "dot", reach, cell=8).collect()}
    assert got == {(m, 1000 * x + y): d for (m, x, y), d in d2.items() if d <= reach * reach}


@pytest.mark.parametrize("thickness", [0, 1])
def test_regions_pass_bands(spark, drawn, thickness):
    segments, pages, pixels, sizes = drawn
    wall = {(m, x + dx, y + dy) for m, x, y in pixels for dx, dy in raster.disc(thickness)}
    free = {(m, x, y) for m, (w, h) in sizes.items() for x in range(w) for y in range(h)} - wall
    want = []
    while free:
        todo = [free.pop()]
        region = set(todo)
        while todo:
            m, x, y = todo.pop()
            around = {(m, x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)} & free
            free -= around
            region |= around
            todo += around
        w, h = sizes[m]
        want.append((m, len(region), any(x in (0, w - 1) or y in (0, h - 1) for _, x, y in region)))
    found = raster.regions(segments, pages, thickness=thickness)
    for sizes_ in (raster.region_sizes(found, pages), raster.sizes(segments, pages, thickness=thickness)):
        assert sorted((r["map_id"], r["n"], r["touches_edge"]) for r in sizes_.collect()) == sorted(want)
    # a region is named by its first run
    first = found.groupBy("map_id", "region").agg(F.min("run").alias("run"))
    assert first.filter("run <> region").count() == 0


def test_only_segments_are_shuffled(spark, drawn):
    segments, pages, _, _ = drawn
    for made in (raster.closed(segments, 2), raster.background_runs(segments, pages), raster.filled_runs(segments, pages, 4.0)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Repartition") == 1 and "Window" not in plan and "Aggregate" not in plan


def test_regions_and_labels_do_not_pass_through_the_driver(spark, monkeypatch):
    """However few bytes the tables have, regions, pages and labels meet by a shuffle; verdicts stay as they were."""
    plans = []

    def kept(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, *args, **kwargs)

    for module in (raster, strategies):
        monkeypatch.setattr(module, "materialize", kept)
    sides = [(2, 2, 12, 2), (12, 2, 12, 12), (12, 12, 2, 12), (2, 12, 2, 2)]
    rows = [(0, i, "green", *map(float, s)) for i, s in enumerate(sides)] + [(0, 9, "route", 3.0, 5.0, 25.0, 5.0)]
    segments = spark.createDataFrame(rows, "map_id long, seg_id long, layer string, x1 double, y1 double, x2 double, y2 double")
    labels = spark.createDataFrame([(0, 1, "7", 0.9, 7.0, 7.0), (0, 2, "8", 0.9, 20.0, 7.0)], "map_id long, label_ord long, text string, conf double, x double, y double")
    pages = spark.createDataFrame([(0, 30, 20)], "map_id long, width long, height long")
    found = strategies.by_regions(segments, labels, pages, thickness=0, least=5)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert [tuple(r) for r in found.select("map_id", "text", "verdict", "label_ord").collect()] == [(0, "7", "crossed", 1)]
    assert "Join" in "".join(plans)
    # ``components`` alone broadcasts nodes of which there are fewer than a thousand
    for plan in plans[:1] + plans[2:]:
        assert "BroadcastHashJoin" not in plan
