"""Plane geometry as Column expressions over DOUBLE or integer coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def turn(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a, b, c: which side of a-b has c."""
    ax, ay, bx, by, cx, cy = map(col, (ax, ay, bx, by, cx, cy))
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_meet(a: str, b: str) -> Column:
    """Closed segments a.x1..y2 and b.x1..y2 have a point in common; exact for integers."""
    p = [F.col(f"{a}.{c}") for c in ("x1", "y1", "x2", "y2")]
    q = [F.col(f"{b}.{c}") for c in ("x1", "y1", "x2", "y2")]
    boxes = (F.greatest(p[0], p[2]) >= F.least(q[0], q[2])) & (F.greatest(q[0], q[2]) >= F.least(p[0], p[2])) & (F.greatest(p[1], p[3]) >= F.least(q[1], q[3])) & (F.greatest(q[1], q[3]) >= F.least(p[1], p[3]))
    one = F.signum(turn(*q, p[0], p[1]).cast("double")) * F.signum(turn(*q, p[2], p[3]).cast("double"))
    two = F.signum(turn(*p, q[0], q[1]).cast("double")) * F.signum(turn(*p, q[2], q[3]).cast("double"))
    return boxes & (one <= 0) & (two <= 0)


def boxes_near(a: str, b: str, reach: float | Column = 0.0) -> Column:
    """The boxes of the segments a and b come within ``reach``, with room for rounding; what no pair of segments farther apart is lost by."""
    apart = lambda c, d: F.greatest(F.least(f"{a}.{c}", f"{a}.{d}") - F.greatest(f"{b}.{c}", f"{b}.{d}"), F.least(f"{b}.{c}", f"{b}.{d}") - F.greatest(f"{a}.{c}", f"{a}.{d}"))
    return (apart("x1", "x2") <= reach + 1e-6) & (apart("y1", "y2") <= reach + 1e-6)


def length(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def undirected_angle(dx, dy) -> Column:
    """Degrees in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(col(dy).cast("double"), col(dx).cast("double"))), F.lit(180.0))


def angle_between(a, b) -> Column:
    """Smallest difference of two undirected angles, in degrees."""
    d = F.abs(col(a) - col(b))
    return F.least(d, 180.0 - d)


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    px, py, x1, y1, x2, y2 = (col(c).cast("double") for c in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / size))).otherwise(0.0)
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def point_segment_offset(px, py, x1, y1, x2, y2) -> Column:
    """``point_segment_distance`` taken from the segment's start, where numbers are small and equal distances stay equal."""
    px, py, x1, y1, x2, y2 = (col(c).cast("double") for c in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / size))).otherwise(0.0)
    ex, ey = px - x1 - t * dx, py - y1 - t * dy
    return F.sqrt(ex * ex + ey * ey)


def segment_distance(a: str, b: str) -> Column:
    """Distance of two closed segments a and b."""
    p = [F.col(f"{a}.{c}") for c in ("x1", "y1", "x2", "y2")]
    q = [F.col(f"{b}.{c}") for c in ("x1", "y1", "x2", "y2")]
    ends = F.least(point_segment_distance(p[0], p[1], *q), point_segment_distance(p[2], p[3], *q), point_segment_distance(q[0], q[1], *p), point_segment_distance(q[2], q[3], *p))
    return F.when(segments_meet(a, b), 0.0).otherwise(ends)


def strip_frame(s: str, px, py) -> tuple[Column, Column, Column]:
    """Place of a point along and across the segment s.x1..y2, and the segment's length."""
    x1, y1, x2, y2 = (F.col(f"{s}.{c}").cast("double") for c in ("x1", "y1", "x2", "y2"))
    n = F.hypot(x2 - x1, y2 - y1)
    dx, dy = col(px) - x1, col(py) - y1
    return (dx * (x2 - x1) + dy * (y2 - y1)) / F.nullif(n, F.lit(0.0)), (dy * (x2 - x1) - dx * (y2 - y1)) / F.nullif(n, F.lit(0.0)), n


def strip_distance(s: str, px, py, half: float | Column) -> Column:
    """Distance of a point from the flat-ended strip of ``half`` to both sides of the segment s."""
    u, v, n = strip_frame(s, px, py)
    return F.hypot(F.greatest(F.lit(0.0), -u, u - n), F.greatest(F.lit(0.0), F.abs(v) - half))


def meets_strip(a: str, s: str, half: float | Column) -> Column:
    """Segment a has a point in the flat-ended strip of ``half`` to both sides of segment s."""
    u1, v1, n = strip_frame(s, f"{a}.x1", f"{a}.y1")
    u2, v2, _ = strip_frame(s, f"{a}.x2", f"{a}.y2")
    t0, t1 = clip_interval(u1, v1, u2 - u1, v2 - v1, 0.0, -half, n, half)
    return t0 <= t1


def to_pixels(v, scale) -> Column:
    """Nearest pixel; halves go to the even one."""
    return F.bround(col(v) * col(scale)).cast("long")


def rounded(v, digits: int) -> Column:
    """As ROUND in SQL engines: what is rounded to zero keeps its sign, which ``F.round`` takes from it."""
    r = F.round(col(v), digits)
    return F.when(r == 0, col(v) * 0.0).otherwise(r)


def clamp(v, lo, hi) -> Column:
    return F.greatest(F.lit(lo) if isinstance(lo, (int, float)) else col(lo), F.least(F.lit(hi) if isinstance(hi, (int, float)) else col(hi), col(v)))


def clip_interval(x1, y1, dx, dy, x_lo, y_lo, x_hi, y_hi) -> tuple[Column, Column]:
    """Parameters (t0, t1) of the part of a segment inside a box; t0 > t1 where there is none."""
    x1, y1, dx, dy, x_lo, y_lo, x_hi, y_hi = (col(c).cast("double") if not isinstance(c, float) else F.lit(c) for c in (x1, y1, dx, dy, x_lo, y_lo, x_hi, y_hi))
    t0, t1 = F.lit(0.0), F.lit(1.0)
    for start, step, lo, hi in ((x1, dx, x_lo, x_hi), (y1, dy, y_lo, y_hi)):
        a, b = (lo - start) / F.nullif(step, F.lit(0.0)), (hi - start) / F.nullif(step, F.lit(0.0))
        inside = (start >= lo) & (start <= hi)
        t0 = F.greatest(t0, F.when(step == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)))
        t1 = F.least(t1, F.when(step == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b)))
    return t0, t1


def ring_area(points: str = "points") -> Column:
    """Signed shoelace area of an array of struct(x, y)."""
    n = F.size(points)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"])
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) / 2
