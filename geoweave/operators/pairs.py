"""Pairs of segments compared many at once, with numpy.

Pairs come from joins on cells in which boxes are compared. As Column expressions the formulas that follow outgrow what
the JVM compiles, and each pair would be interpreted.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

XY = ("x1", "y1", "x2", "y2")


def measured(pairs: DataFrame, keep: list[Column], a: str, b: str, out: tuple[str, ...], run: Callable, more: tuple[Column, ...] = ()) -> DataFrame:
    """``keep`` and the doubles ``out`` of pairs of segments, the struct columns ``a`` and ``b``.

    ``run`` gets the eight coordinates of many pairs, then ``more``, as arrays. It returns which pairs to keep, each as often as
    it is named, and their values in the order of ``out``.
    """
    numbers = [F.col(f"{s}.{c}") for s in (a, b) for c in XY] + list(more)
    rows = pairs.select(*keep, *[c.cast("double").alias(f"__{i}") for i, c in enumerate(numbers)])
    kept = rows.schema.fields[: -len(numbers)]
    names = [f.name for f in kept] + list(out)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            with np.errstate(all="ignore"):
                at, values = run(*(c.to_numpy(zero_copy_only=False) for c in batch.columns[len(kept) :]))
            columns = batch.columns[: len(kept)]
            if len(at) != len(batch) or (at != np.arange(len(batch))).any():
                columns = [c.take(pa.array(at)) for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v) for v in values)], names)

    return rows.mapInArrow(go, StructType(kept + [StructField(n, DoubleType()) for n in out]))


def meet(ax, ay, bx, by, cx, cy, dx, dy) -> np.ndarray:
    """As ``geometry.segments_meet``."""
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    boxes = (np.maximum(ax, bx) >= np.minimum(cx, dx)) & (np.maximum(cx, dx) >= np.minimum(ax, bx)) & (np.maximum(ay, by) >= np.minimum(cy, dy)) & (np.maximum(cy, dy) >= np.minimum(ay, by))
    one = np.sign(vx * (ay - cy) - vy * (ax - cx)) * np.sign(vx * (by - cy) - vy * (bx - cx))
    two = np.sign(ux * (cy - ay) - uy * (cx - ax)) * np.sign(ux * (dy - ay) - uy * (dx - ax))
    return boxes & (one <= 0) & (two <= 0)


def _to_point(px, py, x1, y1, x2, y2) -> np.ndarray:
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = np.where(size > 0, np.clip(((px - x1) * dx + (py - y1) * dy) / np.where(size > 0, size, 1.0), 0.0, 1.0), 0.0)
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return np.sqrt(ex * ex + ey * ey)


def distance(*ends) -> np.ndarray:
    """As ``geometry.segment_distance``."""
    p, q = ends[:4], ends[4:]
    apart = np.minimum(np.minimum(_to_point(*p[:2], *q), _to_point(*p[2:], *q)), np.minimum(_to_point(*q[:2], *p), _to_point(*q[2:], *p)))
    return np.where(meet(*ends), 0.0, apart)


def cuts(ax, ay, bx, by, cx, cy, dx, dy) -> tuple[np.ndarray, list[np.ndarray]]:
    """(pair, (second, x1..y2, t)): where the segments of a pair cut each other inside; ``second`` is 1 for cuts of the second one.

    Of segments along each other each is cut at the other's ends.
    """
    found = []
    met = np.flatnonzero(meet(ax, ay, bx, by, cx, cy, dx, dy))
    p, q = [c[met] for c in (ax, ay, bx, by)], [c[met] for c in (cx, cy, dx, dy)]
    for second, (one, other) in enumerate(((p, q), (q, p))):
        ux, uy, vx, vy = one[2] - one[0], one[3] - one[1], other[2] - other[0], other[3] - other[1]
        cross = ux * vy - uy * vx
        along = lambda x, y: ((x - one[0]) * ux + (y - one[1]) * uy) / (ux * ux + uy * uy)  # noqa: E731, B023
        level = cross == 0
        first = np.where(level, along(*other[:2]), ((other[0] - one[0]) * vy - (other[1] - one[1]) * vx) / np.where(level, 1.0, cross))
        for some, t in ((np.ones(len(met), bool), first), (level, along(*other[2:]))):
            at = np.flatnonzero(some & (t > 0) & (t < 1))
            found.append((met[at], np.full(len(at), float(second)), *(c[at] for c in one), t[at]))
    at, *values = (np.concatenate(c) for c in zip(*found))
    return at, values


def clipped(x, y, dx, dy, x_lo, y_lo, x_hi, y_hi) -> tuple[np.ndarray, np.ndarray]:
    """As ``geometry.clip_interval``."""
    t0, t1 = np.zeros(len(x)), np.ones(len(x))
    for start, step, lo, hi in ((x, dx, x_lo, x_hi), (y, dy, y_lo, y_hi)):
        still, inside = step == 0, (start >= lo) & (start <= hi)
        by = np.where(still, 1.0, step)
        a, b = (lo - start) / by, (hi - start) / by
        t0 = np.maximum(t0, np.where(still, np.where(inside, 0.0, 2.0), np.minimum(a, b)))
        t1 = np.minimum(t1, np.where(still, np.where(inside, 1.0, -1.0), np.maximum(a, b)))
    return t0, t1


def meet_strip(ax, ay, bx, by, cx, cy, dx, dy, half) -> np.ndarray:
    """The first segment meets the second, or its flat-ended strip of ``half`` to both sides; a place has no strip."""
    n = np.hypot(dx - cx, dy - cy)
    place = lambda x, y: (((x - cx) * (dx - cx) + (y - cy) * (dy - cy)) / n, ((y - cy) * (dx - cx) - (x - cx) * (dy - cy)) / n)
    (u1, v1), (u2, v2) = place(ax, ay), place(bx, by)
    t0, t1 = clipped(u1, v1, u2 - u1, v2 - v1, 0.0, -half, n, half)
    return meet(ax, ay, bx, by, cx, cy, dx, dy) | ((n > 0) & (t0 <= t1))


def near_interval(radius: float, round_ends: bool) -> Callable:
    """The part (t0, t1) of the first segment within ``radius`` of the second one; -1 and -1 where there is none."""

    def run(ax, ay, bx, by, cx, cy, dx, dy) -> tuple[np.ndarray, list[np.ndarray]]:
        n = np.sqrt((dx - cx) * (dx - cx) + (dy - cy) * (dy - cy))
        size = np.where(n > 0, n, 1.0)
        vx, vy = np.where(n > 0, (dx - cx) / size, 1.0), (dy - cy) / size
        # place and step of the first along and across the second
        s, c = (ax - cx) * vx + (ay - cy) * vy, (ay - cy) * vx - (ax - cx) * vy
        ds, dc = (bx - ax) * vx + (by - ay) * vy, (by - ay) * vx - (bx - ax) * vy
        parts = [clipped(s, c, ds, dc, 0.0, -radius, n, radius)]
        a = ds * ds + dc * dc
        for end in (0.0, n) if round_ends else ():
            off = s - end
            b, rest = off * ds + c * dc, off * off + c * c - radius * radius
            met = (b * b >= a * rest) & (a > 0)
            root, by_ = np.sqrt(np.maximum(0.0, b * b - a * rest)), np.where(a > 0, a, 1.0)
            parts.append((np.where(met, np.maximum(0.0, (-b - root) / by_), 2.0), np.where(met, np.minimum(1.0, (-b + root) / by_), -1.0)))
        first = np.minimum.reduce([np.where(p <= q, p, np.inf) for p, q in parts])
        last = np.maximum.reduce([np.where(p <= q, q, -np.inf) for p, q in parts])
        none = ~(first <= last)
        return np.arange(len(n)), [np.where(none, -1.0, first), np.where(none, -1.0, last)]

    return run


def first_met(least: float) -> Callable:
    """The pairs whose first segment, as a ray, meets the second beyond ``least`` of its length, and the share t up to there."""

    def run(ax, ay, bx, by, cx, cy, dx, dy) -> tuple[np.ndarray, list[np.ndarray]]:
        ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
        cross = ux * vy - uy * vx
        t = ((cx - ax) * vy - (cy - ay) * vx) / np.where(cross != 0, cross, 1.0)
        at = np.flatnonzero(meet(ax, ay, bx, by, cx, cy, dx, dy) & (cross != 0) & (t > least))
        return at, [t[at]]

    return run
