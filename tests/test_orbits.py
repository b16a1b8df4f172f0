"""Cycles followed inside tasks, and the pairs that faces and routes are compared in."""

import random

from geoweave.operators import faces, graphs, topology


def ring(face, x0, y0, x1, y1):
    p = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return [(0, face, *map(float, a + b)) for a, b in zip(p, p[1:] + p[:1])]


def test_cycles_that_pass_many_parts(spark):
    """Short cycles and long ones, dealt at random to parts that each see a few of their links."""
    rng = random.Random(7)
    rows, want = [], {}
    for m in (5, 9):
        edges = [(rng.randrange(1 << 60), rng.randrange(1 << 60)) for _ in range(400)]
        at = 0
        while at < len(edges):
            one = edges[at : at + rng.choice((1, 2, 3, 30, 90))]
            at += len(one)
            rows += [(m, *e, *n) for e, n in zip(one, one[1:] + one[:1])]
            want |= {(m, *e): min(one) for e in one}
    links = spark.createDataFrame(rows, "map_id long, u long, v long, ju long, jv long").repartition(6)
    got = graphs.cycle_labels(links).collect()
    assert len(got) == len(rows) and {(r["map_id"], r["u"], r["v"]): (r["lu"], r["lv"]) for r in got} == want
    whole = graphs.cycle_labels(links.coalesce(1)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, got))


def test_points_meet_only_lines_of_rings_around_them(spark):
    """A row of rings in one stripe: each point is joined with the four lines of its own ring, or of none."""
    lines = spark.createDataFrame([r for k in range(30) for r in ring(k, 10 * k, 0, 10 * k + 8, 8)], "map_id long, face_id long, x1 double, y1 double, x2 double, y2 double")
    dots = spark.createDataFrame([(0, k, 10.0 * k + d, 4.0) for k, d in ((0, 4), (7, 4), (12, 8), (13, 9))], "map_id long, ord long, x double, y double")
    found = topology.points_in_rings(dots, lines, "ord", "face_id")
    assert sorted(map(tuple, found.collect())) == [(0, 0, 0), (0, 7, 7)]
    joins = [row for row in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in row]
    assert any("face_id" in row and "stripe" in row for row in joins)


def test_a_route_is_tried_in_the_faces_whose_box_it_passes(spark, monkeypatch):
    """Nine faces share a cell of the grid; the route passes the boxes of two."""
    seen = {}
    plain = faces.materialize

    def watched(df, name, *more, **kinds):
        seen[name] = plain(df, name, *more, **kinds)
        return seen[name]

    monkeypatch.setattr(faces, "materialize", watched)
    boxes = [(k, 20.0 * (k % 3), 20.0 * (k // 3)) for k in range(9)]
    edges = spark.createDataFrame([r for k, x, y in boxes for r in ring(k, x, y, x + 10, y + 10)], "map_id long, face_id long, x1 double, y1 double, x2 double, y2 double")
    made = spark.createDataFrame([(0, k, x, y, x + 10, y + 10) for k, x, y in boxes], "map_id long, face_id long, x_min double, y_min double, x_max double, y_max double")
    # x + y = 50: through faces 4 and 2
    route = spark.createDataFrame([(0, 1, 28, 22, 62, -12)], "map_id long, seg_id long, x1 long, y1 long, x2 long, y2 long")
    inside = faces.length_inside(made, edges, route).collect()
    assert {r["face_id"] for r in inside} == {2, 4} and {r["face_id"] for r in seen["pieces"].collect()} == {2, 4}


def test_short_cycles_take_no_rounds(spark, monkeypatch):
    """Cycles that lie in one part are found at one shuffle, with their steps; longer ones go on in rounds, to the same result."""
    rng = random.Random(11)
    rows, want = [], set()
    for m in range(6):
        edges = list({(rng.randrange(1 << 40), rng.randrange(1 << 40)) for _ in range(200)})
        while edges:
            k = rng.choice((1, 2, 3, 7, 60))
            one, edges = edges[:k], edges[k:]
            rows += [(m, *e, *n) for e, n in zip(one, one[1:] + one[:1])]
            least = one.index(min(one))
            want |= {(m, *e, *min(one), (least - i) % len(one)) for i, e in enumerate(one)}
    rows += [(9, 1, 2, 2, 3), (9, 2, 3, 3, 4)]  # on no cycle
    links = spark.createDataFrame(rows, "map_id long, u long, v long, ju long, jv long")
    made, plain = [], graphs.materialize
    monkeypatch.setattr(graphs, "materialize", lambda df, name, **seen: made.append(name) or plain(df, name, **seen))
    assert set(map(tuple, graphs.cycles(links.filter("map_id < 9")).collect())) == want and made == ["cycles"]
    monkeypatch.setattr(graphs, "FOLLOWED", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 150)
    try:
        made.clear()
        assert set(map(tuple, graphs.cycles(links).collect())) == want and len(made) > 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
