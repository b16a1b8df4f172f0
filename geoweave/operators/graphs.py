"""Connected components of links, as joins."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.operators import skew
from geoweave.scratch import forget, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Links that one task follows at once.
FOLLOWED = 200_000


def _with_least(rows: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """rows(u, v) with m of least(u, m, n); nodes with more than ``most`` rows are few and get it by a broadcast."""
    hot = F.broadcast(least.filter(F.col("n") > most).select("u", F.col("m").alias("hot")))
    marked = rows.join(hot, "u", "left")
    cold = marked.filter("hot IS NULL").select("u", "v").join(least.filter(F.col("n") <= most).select("u", "m").hint("merge"), "u")
    return marked.filter("hot IS NOT NULL").select("u", "v", F.col("hot").alias("m")).union(cold.select("u", "v", "m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached over links(a, b), for all nodes with a link.

    Rounds of large stars and small stars: their number grows with the logarithm
    of the nodes, and no component is gathered in one task, nor are the links of
    one node.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    most = skew.limit_of(2 * edges.count())
    while True:
        # large star: every larger neighbour of u goes to u's least neighbour
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = materialize(_with_least(both.filter("v > u"), least, most).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        # small star: u and its lesser neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = _with_least(large, least, most).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        forget(edges)
        forget(large)
        edges = after
        # stars only: every leaf has one root, and no root is a leaf
        ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf")))))
        seen = ends.groupBy("node").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("root"))
        if not seen.agg(F.count_if(F.expr("n > 1 OR (n = 1 AND root = 0)"))).first()[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def cycles(links: DataFrame, by: str = "map_id") -> DataFrame:
    """(by, u, v, lu, lv, steps): the least edge (lu, lv) of each edge's cycle, and how many steps ahead it is.

    ``links`` has for each directed edge (u, v) the next one (ju, jv). Cycles that lie whole in a part of ``FOLLOWED`` links of a
    map are found with numpy, at one shuffle. Of the others pointers are doubled; an edge
    whose two windows have the same least edge has seen its whole cycle, and all edges of that
    cycle have one round later. They then leave, so short cycles cost few rounds and later rounds only carry
    the edges of long ones. Edges that do not lie on a cycle are left out. Links that stand for whole chains bring the
    least edge of theirs as (lu, lv); ``steps`` then counts chains.
    """
    edge = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    least = ("lu", "lv") if "lu" in links.columns else ("u", "v")
    rows = links.select(by, *[F.col(c).cast("long").alias(n) for c, n in zip(("u", "v", "ju", "jv", *least), ("u", "v", "ju", "jv", "lu", "lv"))])
    # a map's links lie together; those of a map that has very many are dealt to several tasks
    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    state = materialize(rows.hint("rebalance", by).mapInArrow(_in_parts(_closed, FOLLOWED), f"{kinds}, steps long, done boolean"), "cycles", open=F.count_if(~F.col("done")))
    found = state.filter("done").select(by, "u", "v", "lu", "lv", "steps")
    if not state.seen["open"]:
        return found
    # no cycle is longer than all edges together
    bound, width, before = 2 * state.seen["open"], 1, []
    state = state.filter("NOT done")
    while True:
        ahead = state.select(by, F.col("u").alias("ju"), F.col("v").alias("jv"), F.col("ju").alias("ku"), F.col("jv").alias("kv"), F.col("lu").alias("mu"), F.col("lv").alias("mv"), F.col("steps").alias("more"))
        met = state.filter("NOT done").join(ahead, [by, "ju", "jv"])
        less = edge("mu", "mv") < edge("lu", "lv")
        after = met.select(
            by, "u", "v", F.col("ku").alias("ju"), F.col("kv").alias("jv"),
            F.when(less, F.col("mu")).otherwise(F.col("lu")).alias("lu"), F.when(less, F.col("mv")).otherwise(F.col("lv")).alias("lv"),
            F.when(less, F.col("more") + width).otherwise(F.col("steps")).alias("steps"), (edge("mu", "mv") == edge("lu", "lv")).alias("done"),
        )
        state = materialize(after, "cycles", closed=F.count_if("done"), open=F.count_if(~F.col("done")))
        for old in before:
            forget(old)
        if state.seen["closed"]:
            found, before = found.unionByName(state.filter("done").select(by, "u", "v", "lu", "lv", "steps")), []
        else:  # without a finished edge, only the next round reads it
            before = [state]
        width *= 2
        if not state.seen["open"] or width > bound:
            return materialize(found, "found")


def cycle_labels(links: DataFrame, by: str = "map_id") -> DataFrame:
    """(by, u, v, lu, lv): as ``cycles``, for links of which every edge is the next of just one.

    Links are followed with numpy inside the tasks that hold them first, ``FOLLOWED`` at a time: cycles that lie whole in such a
    part are done, and of the others each chain becomes one link. Any part will do, but the nearer its links, the fewer chains.
    """
    kind = dict(links.dtypes)[by]
    ends = "u long, v long, lu long, lv long, closed boolean, ju long, jv long, cu long, cv long"
    rows = links.select(by, *[F.col(c).cast("long").alias(c) for c in ("u", "v", "ju", "jv")])
    local = materialize(rows.mapInArrow(_in_parts(_followed, FOLLOWED), f"{by} {kind}, {ends}"), "followed")
    chains = local.filter("ju IS NOT NULL").select(by, "u", "v", "ju", "jv", F.col("cu").alias("lu"), F.col("cv").alias("lv"))
    found = cycles(chains, by).select(by, F.col("u").alias("hu"), F.col("v").alias("hv"), F.col("lu").alias("fu"), F.col("lv").alias("fv"))
    opened = local.filter("NOT closed").select(by, "u", "v", F.col("lu").alias("hu"), F.col("lv").alias("hv")).join(found, [by, "hu", "hv"])
    return local.filter("closed").select(by, "u", "v", "lu", "lv").unionByName(opened.select(by, "u", "v", F.col("fu").alias("lu"), F.col("fv").alias("lv")))


def _next(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(of, u, v, ju, jv, order, to): the columns of links, their order by map and edge, and where the next link of each is, -1 if not here."""
    of = np.unique(table.column(0).to_numpy(), return_inverse=True)[1].astype(np.int64)
    u, v, ju, jv = (table.column(k).to_numpy() for k in (1, 2, 3, 4))
    nodes = np.unique(np.concatenate([u, v, ju, jv]))
    code = lambda a, b: (of * len(nodes) + np.searchsorted(nodes, a)) * len(nodes) + np.searchsorted(nodes, b)
    own, following = code(u, v), code(ju, jv)
    order = np.argsort(own, kind="stable")
    place = np.minimum(np.searchsorted(own, following, sorter=order), len(own) - 1)
    return of, u, v, ju, jv, order, np.where(own[order[place]] == following, order[place], -1)


def _closed(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links (map, u, v, ju, jv, lu, lv) with the least edge of their cycle, how many steps ahead it is, and whether the cycle lies here; others are as they were."""
    of, u, v, ju, jv, _, to = _next(table)
    lu, lv = (table.column(k).to_numpy() for k in (5, 6))
    order, least = np.lexsort((lv, lu, of)), np.empty(len(to), np.int64)
    least[order] = np.arange(len(to))
    step, steps, closed, width = to.copy(), np.zeros(len(to), np.int64), np.zeros(len(to), bool), 1
    at = np.flatnonzero(step >= 0)
    while len(at):
        ahead = step[at]
        wraps, less = least[ahead] == least[at], least[ahead] < least[at]
        new = np.minimum(least[ahead], least[at]), np.where(less, steps[ahead] + width, steps[at]), step[ahead]
        least[at], steps[at], step[at] = new
        closed[at[wraps]] = True
        at, width = at[~wraps & (step[at] >= 0)], 2 * width
    # where a link leads into a cycle from outside, that is left as it was
    merged = np.bincount(to[to >= 0], minlength=len(to)) > 1
    closed &= ~np.isin(least, least[merged & closed])
    named = np.where(closed, order[least], np.arange(len(to)))
    columns = [table.column(0).combine_chunks(), *(pa.array(c) for c in (u, v, ju, jv, lu[named], lv[named], np.where(closed, steps, 0), closed))]
    yield from pa.Table.from_arrays(columns, [*table.column_names, "steps", "done"]).to_batches(max_chunksize=50_000)


def _followed(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The least edge of each link's cycle, or else the first edge of its chain, which has the chain's next and least edges."""
    _, u, v, ju, jv, order, to = _next(table)
    # ranks order the edges of one map as (u, v) does
    least = np.empty(len(to), np.int64)
    least[order] = np.arange(len(to))
    head = np.ones(len(to), bool)
    head[to[to >= 0]] = False
    step, last, closed = to.copy(), np.arange(len(to)), np.zeros(len(to), bool)
    at = np.flatnonzero(step >= 0)
    while len(at):
        ahead = step[at]
        wraps = least[ahead] == least[at]
        new = np.minimum(least[ahead], least[at]), last[ahead], step[ahead]
        least[at], last[at], step[at] = new
        closed[at[wraps]] = True
        at = at[~wraps & (step[at] >= 0)]
    first = np.flatnonzero(head)
    head_of = np.full(len(to), -1)
    head_of[last[first]] = first
    named = np.where(closed, order[least], head_of[last])
    some = lambda values: pa.array(values, mask=~head)
    columns = [table.column(0).combine_chunks(), *(pa.array(c) for c in (u, v, u[named], v[named], closed)), *(some(c) for c in (ju[last], jv[last], u[order[least]], v[order[least]]))]
    out = pa.Table.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], [table.column_names[0], "u", "v", "lu", "lv", "closed", "ju", "jv", "cu", "cv"])
    yield from out.to_batches(max_chunksize=50_000)


def _in_parts(run: Callable, most: int) -> Callable:
    """``run`` over Arrow batches, about ``most`` rows at a time."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= most:
                yield from run(pa.Table.from_batches(held).combine_chunks())
                held = []
        if sum(len(b) for b in held):
            yield from run(pa.Table.from_batches(held).combine_chunks())

    return go
