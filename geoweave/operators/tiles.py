"""Bands of a map's lines, each drawn and swept by one task, with numpy.

Segments are dealt by map and band before they are drawn, so that no pixel is shuffled. A segment is
a run of pixels for each of its lines; what lies within a reach of it is again one run for
each line, and all runs of a band are kept on one axis, line after line.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lines of a band.
BAND = 256
FAR = 1 << 40
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def lines_of(a, b, c, d, top: int | np.ndarray, bottom: int | np.ndarray) -> Runs:
    """(seg, py, lo, hi): segments from a, b to c, d, in whole pixels, as a run for each line from ``top`` to ``bottom``.

    A run holds the pixels of all steps along the longer axis that fall on its line, halves going to the even pixel.
    """
    s, t = np.abs(c - a), np.abs(d - b)
    first, last = np.maximum(np.minimum(b, d), top), np.minimum(np.maximum(b, d), bottom)
    count = np.maximum(last - first + 1, 0)
    seg = np.repeat(np.arange(len(a)), count)
    py = np.arange(len(seg)) - (np.cumsum(count) - count - first)[seg]
    j = np.abs(py - b[seg])
    s, t = s[seg], t[seg]
    n = np.maximum(s, t)
    m = np.maximum(n, 1)
    at, rest = np.divmod(2 * s * j + m, 2 * m)
    at -= (rest == 0) & (at % 2 == 1)
    # of a flat segment, the steps whose line is j: halves belong to the even line
    u, low, high, odd = 2 * np.maximum(t, 1), (2 * j - 1) * n, (2 * j + 1) * n, j % 2 == 1
    k0 = np.where(t == 0, 0, np.maximum(np.where(odd, low // u + 1, -(-low // u)), 0))
    k1 = np.where(t == 0, n, np.minimum(np.where(odd, -(-high // u) - 1, high // u), n))
    sign = np.where(c < a, -1, 1)[seg]
    steep = t >= s
    x0, x1 = a[seg] + sign * np.where(steep, at, k0), a[seg] + sign * np.where(steep, at, k1)
    return seg, py, np.minimum(x0, x1), np.maximum(x0, x1)


def widened(runs: Runs, reach: float) -> Runs:
    """What lies within ``reach`` of the runs; those of one segment, line by line, stay one run for each line."""
    seg, py, lo, hi = runs
    r = int(reach)
    if not len(py) or not r:
        return runs
    new = np.r_[True, (seg[1:] != seg[:-1]) | (py[1:] != py[:-1] + 1) | (lo[1:] > hi[:-1] + 1) | (hi[1:] < lo[:-1] - 1)]
    piece = np.cumsum(new) - 1
    size = len(py) + 2 * r * (piece[-1] + 1)
    at = np.arange(len(py)) + (2 * piece + 2) * r
    left, right = np.full(size + 2 * r, FAR), np.full(size + 2 * r, -FAR)
    left[at], right[at] = lo, hi
    out_lo, out_hi = np.full(size, FAR), np.full(size, -FAR)
    for off in range(-r, r + 1):
        w, view = math.floor(math.sqrt(reach * reach - off * off)), slice(r + off, r + off + size)
        np.minimum(out_lo, left[view] - w, out=out_lo)
        np.maximum(out_hi, right[view] + w, out=out_hi)
    starts = np.flatnonzero(new)
    count = np.diff(np.r_[starts, len(py)]) + 2 * r
    of = np.repeat(np.arange(len(starts)), count)
    return seg[starts][of], np.arange(size) - (np.cumsum(count) - count - py[starts] + r)[of], out_lo, out_hi


def on_page(runs: Runs, width: int, height: int) -> Runs:
    seg, py, lo, hi = runs
    keep = (py >= 0) & (py < height) & (hi >= 0) & (lo < width)
    return seg[keep], py[keep], np.maximum(lo[keep], 0), np.minimum(hi[keep], width - 1)


def nearest(px, py, a, b, c, d, width, height, reach: float) -> np.ndarray:
    """For pairs of a pixel and a segment the squared distance of the segment's pixels on their page; ``FAR`` where they are out of reach."""
    r = int(reach)
    pair, y, lo, hi = lines_of(a, b, c, d, np.maximum(py - r, 0), np.minimum(py + r, height - 1))
    lo, hi = np.maximum(lo, 0), np.minimum(hi, width[pair] - 1)
    dx, dy = np.maximum(np.maximum(lo - px[pair], px[pair] - hi), 0), y - py[pair]
    d2 = np.full(len(px), FAR)
    some = lo <= hi
    np.minimum.at(d2, pair[some], (dx * dx + dy * dy)[some])
    return d2


def union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of whole numbers as few as can be, in order."""
    order = np.argsort(lo, kind="stable")
    lo, reached = lo[order], np.maximum.accumulate(hi[order])
    starts = np.flatnonzero(np.r_[True, lo[1:] > reached[:-1] + 1])
    return lo[starts], reached[np.r_[starts[1:], len(lo)] - 1]


def free(runs: Runs, top: int, bottom: int, width: int) -> Runs:
    """What the runs leave of the page's lines from ``top`` to ``bottom``; no run has a segment."""
    _, py, lo, hi = runs
    wide = width + 2
    keep = (py >= top) & (py <= bottom) & (hi >= 0) & (lo < width)
    lo, hi = np.maximum(lo, 0), np.minimum(hi, width - 1)
    at, base = (py[keep] - top) * wide + 1, np.arange(bottom - top + 1) * wide
    # the page's sides are drawn as well, so nothing goes on from line to line
    l, h = union(np.concatenate([base, base + wide - 1, at + lo[keep]]), np.concatenate([base, base + wide - 1, at + hi[keep]]))
    l, h = h[:-1] + 1, l[1:] - 1
    return np.full(len(l), -1), top + l // wide, l % wide - 1, h % wide - 1


def joined(a: Runs, b: Runs) -> Runs:
    return tuple(np.concatenate(p) for p in zip(a, b))


def filled(drawn: Runs, top: int, bottom: int, width: int, most: float) -> Runs:
    """What is free once all that is farther than ``most`` from the runs is drawn too."""
    return free(joined(drawn, free(widened(drawn, most), top, bottom, width)), top, bottom, width)


def parts(py: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each of these runs, in order, the first run of the part that it belongs to; runs touch at corners too."""
    root = np.arange(len(py))
    if not len(py):
        return root
    wide = hi.max() + 3
    l, h = py * wide + lo, py * wide + hi
    first = np.searchsorted(h, l + wide - 1)
    count = np.maximum(np.searchsorted(l, h + wide + 1, "right") - first, 0)
    a = np.repeat(root, count)
    b = np.arange(len(a)) - (np.cumsum(count) - count - first)[a]
    while len(a):
        p, q = root[a], root[b]
        open_ = p != q
        a, b, p, q = a[open_], b[open_], p[open_], q[open_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return root


def closed(runs: Runs, radius: int, top: int, bottom: int) -> tuple[np.ndarray, np.ndarray]:
    """(px, py) from ``top`` to ``bottom`` of the runs thickened and then thinned by ``radius``."""
    _, py, lo, hi = widened(runs, radius)
    if not len(py):
        return py, py
    x0, y0 = lo.min(), py.min() - radius
    wide = hi.max() - x0 + 3
    l, h = union((py - y0) * wide + lo - x0, (py - y0) * wide + hi - x0)
    starts, stops = [], []
    for off in range(-radius, radius + 1):
        w = math.floor(math.sqrt(radius * radius - off * off))
        keep = h - l >= 2 * w
        starts.append(l[keep] + off * wide + w)
        stops.append(h[keep] + off * wide - w + 1)
    at, step = np.concatenate(starts + stops), np.repeat([1, -1], [sum(map(len, starts)), sum(map(len, stops))])
    order = np.argsort(at, kind="stable")
    at, depth = at[order], np.cumsum(step[order])
    # a pixel stays where all lines of its disc are covered
    full = np.flatnonzero((depth[:-1] == 2 * radius + 1) & (at[1:] > at[:-1]))
    count = at[full + 1] - at[full]
    p = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - at[full], count)
    px, py = p % wide + x0, p // wide + y0
    keep = (py >= top) & (py <= bottom)
    return px[keep], py[keep]


def swept(strokes: DataFrame, pages: DataFrame | None, around: int, run: Callable, schema: str) -> DataFrame:
    """map_id and the columns of ``run(runs, top, bottom, width, height)`` for every band of every map.

    ``strokes`` (map_id, a, b, c, d) are segments in whole pixels, dealt to the bands that they come within
    ``around`` lines of; ``pages`` gives width and height, and maps without a page are left out. Without pages every band that a
    stroke may reach is swept.
    """
    band = lambda y: F.floor(y / BAND)
    reached = F.sequence(band(F.least("b", "d") - around), band(F.greatest("b", "d") + around))
    none, paged = F.lit(None).cast("long"), pages is not None
    rows = strokes.select("map_id", "a", "b", "c", "d", none.alias("width"), none.alias("height"), F.explode(reached).alias("band"))
    if paged:
        sheets = pages.filter("width > 0 AND height > 0").select("map_id", *[none.alias(c) for c in "abcd"], F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
        rows = rows.unionByName(sheets.withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), band(F.col("height") - 1)))))
    names = [c.split()[0] for c in schema.split(", ")]

    def tile(table: pa.Table) -> pa.Table:
        top = table["band"][0].as_py() * BAND
        bottom, width, height = top + BAND - 1, pc.max(table["width"]).as_py(), pc.max(table["height"]).as_py()
        if paged and width is not None:
            bottom = min(bottom, height - 1)
        drawn = table.filter(pc.is_valid(table["a"]))
        a, b, c, d = (drawn[k].to_numpy() for k in "abcd")
        if paged and width is None:
            a, b, c, d = (x[:0] for x in (a, b, c, d))
            bottom = top - 1
        out = run(lines_of(a, b, c, d, top - around, bottom + around), top, bottom, width, height) if bottom >= top else [np.zeros(0, np.int64)] * len(names)
        return pa.table({"map_id": pa.repeat(table["map_id"][0], len(out[0])), **dict(zip(names, out))})

    kind = dict(strokes.dtypes)["map_id"]
    # a stroke is a small row that makes many runs: the number of tasks must not follow the bytes shuffled
    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "map_id", "band")
    return spread.groupBy("map_id", "band").applyInArrow(tile, f"map_id {kind}, {schema}")
