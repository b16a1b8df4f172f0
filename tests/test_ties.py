"""Results that rounding alone would decide."""

import duckdb

from geoweave import oracle
from geoweave.operators import directions, topology
from geoweave.operators import labels as lb
from geoweave.plans import strategies
from geoweave.queries import QUERIES


def test_equal_distances_go_to_the_first_label(spark):
    """Two labels at one offset from two copies of a segment, far from each other."""
    route = spark.createDataFrame([(0, 1, 483.0, 388.0, 497.0, 395.0), (0, 2, 914.0, 399.0, 928.0, 406.0)], "map_id long, seg_id long, x1 double, y1 double, x2 double, y2 double")
    labels = spark.createDataFrame([(0, 1, 494.5, 369.25), (0, 2, 925.5, 380.25)], "map_id long, label_ord long, x double, y double")
    assert [r["label_ord"] for r in strategies.nearest_labels(labels, route, 200.0).collect()] == [1]


def test_an_upright_axis_has_one_sign(spark):
    """The covariance of these points is nothing; whatever their order, the axis is 90 degrees, never -90."""
    points = [(14.0, 6.5), (12.0, 87.5), (15.5, 48.5), (10.0, 14.5), (7.5, 24.5), (5.5, 51.5)]
    rows = [(m, *p) for m in range(6) for p in points[m:] + points[:m]]
    got = directions.principal_axis(spark.createDataFrame(rows, "map_id long, x double, y double").coalesce(1), ["map_id"]).collect()
    assert {(r["map_id"], r["axis"]) for r in got} == {(m, 90.0) for m in range(6)}
    square = spark.createDataFrame([(0, x / 3, y / 3) for x in (1, 2) for y in (1, 2)], "map_id long, x double, y double")
    assert [r["axis"] for r in directions.principal_axis(square, ["map_id"]).collect()] == [0.0]


def test_cuts_are_dealt_once(spark):
    """Three segments through one place, twice: each is cut there once, and no cut is joined with its segment again."""
    rows = [(0, i, *map(float, r)) for i, r in enumerate([(0, 0, 10, 10), (0, 10, 10, 0), (5, 0, 5, 10), (0, 5, 10, 5)])]
    edges = topology.noded_edges(spark.createDataFrame(rows, "map_id long, seg_id long, x1 double, y1 double, x2 double, y2 double"))
    assert edges.count() == 8
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate") == 1


def test_few_pairs_are_left_to_group_along_a_route(spark):
    """A label in reach of many segments leaves one pair of each batch; of equally near ones the first counts."""
    rows = [(0, i, 10.0 * i, 0.0, 10.0 * i + 10, 0.0) for i in range(60)] + [(0, 100, 300.0, 0.0, 310.0, 0.0)]
    route = spark.createDataFrame(rows, "map_id long, seg_id long, x1 double, y1 double, x2 double, y2 double")
    labels = spark.createDataFrame([(0, 1, 305.0, 7.0), (0, 2, 310.0, 7.0), (0, 3, 305.0, 900.0)], "map_id long, label_ord long, x double, y double")
    assert {(r["label_ord"], r["s"]) for r in lb.along_route(labels, route).collect()} == {(1, 305.0), (2, 310.0), (3, 305.0)}
    pairs = spark.createDataFrame([(0, k % 3, s, float(abs(s - 40) // 2)) for s in range(80) for k in range(3)], "map_id long, label_ord long, seg_id long, d double")
    assert sorted(tuple(r) for r in lb.nearest_in_batches(pairs.coalesce(1)).collect()) == [(0, k, 39, 0.0) for k in range(3)]
    plan = lb.along_route(labels, route)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_place_just_under_zero_keeps_its_sign(spark, tmp_path):
    """One line's end lies at y = -0.00048, which the SQL rounds to -0.0."""
    keys = [2083000 + k for k in (7, 56, 80, 107, 118, 129, 242, 255, 304, 366, 390, 428)]
    spark.createDataFrame([(k, "1-URGENT") for k in keys], "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(tables.execute(oracle.ORACLE["tangent_crosslines"]).fetchall())
    assert "-0.0" in {str(r[3]) for r in want}
    got = sorted(tuple(r) for r in QUERIES["tangent_crosslines"](spark, str(tmp_path)).collect())
    assert [str(r) for r in got] == [str(r) for r in want]
