"""Clusters in one dimension, ordered folds over points, greedy matching, radius clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.operators.spatial import range_join
from geoweave.scratch import materialize


def width_split(drawings: DataFrame) -> DataFrame:
    """For each map the threshold in the largest gap of its distinct widths.

    Widths are rounded to two decimals and 0 is left out; there must be two at
    least, 0.3 apart in all; of equal gaps the first counts.
    """
    widths = drawings.select("map_id", F.round("width", 2).alias("w")).filter("w > 0").distinct()
    w = Window.partitionBy("map_id").orderBy("w")
    gaps = widths.withColumn("before", F.lag("w").over(w)).withColumn("gap", F.round(F.col("w") - F.col("before"), 6))
    best = gaps.groupBy("map_id").agg((F.max("w") - F.min("w")).alias("range"), F.max_by(F.struct("before", "w"), F.struct("gap", -F.col("w"))).alias("b"), F.max("gap").alias("gap"))
    return best.filter("gap IS NOT NULL AND range >= 0.3").select("map_id", "gap", ((F.col("b.before") + F.col("b.w")) / 2).alias("threshold"))


def cluster_1d(points: DataFrame, value: str, gap: float = 15.0, by: str = "map_id", tie: str = "seg_id") -> DataFrame:
    """Adds `cluster`, counted from 1: a new one begins where the step from the value before is over ``gap``."""
    w = Window.partitionBy(by).orderBy(value, tie)
    new = F.when(F.col(value) - F.lag(value).over(w) <= gap, 0).otherwise(1)
    return points.withColumn("cluster", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def cut_at_gaps(points: DataFrame, reach: float, by: str = "map_id", order: str = "ord", turns: int = 4) -> DataFrame:
    """Adds `chain`, a string: points are cut at gaps of ``reach`` along x, then y, in turns."""
    keys: list[str] = []
    for turn in range(turns):
        axis = "xy"[turn % 2]
        w = Window.partitionBy(by, *keys).orderBy(axis, order)
        step = F.col(axis) - F.lag(axis).over(w)
        new = F.when(step < reach, 0).otherwise(1)
        points = points.withColumn(f"__cut{turn}", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        keys.append(f"__cut{turn}")
    return points.withColumn("chain", F.concat_ws(".", *keys)).drop(*keys)


def thin(points: DataFrame, least: float = 2.0, by: str = "map_id", order: str = "ord") -> DataFrame:
    """Points in order without those closer than ``least`` to the last one kept.

    What is kept depends on all points before, so one group's points are one array.
    """
    runs = points.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "x", "y"))).alias("run"))

    def step(kept, new):
        last = F.element_at(kept, -1)
        far = F.hypot(new["x"] - last["x"], new["y"] - last["y"]) >= least
        return F.when((F.size(kept) == 0) | far, F.concat(kept, F.array(new))).otherwise(kept)

    return runs.select(by, F.inline(F.aggregate("run", F.filter("run", lambda r: F.lit(False)), step)))


def greedy_match(pairs: DataFrame) -> DataFrame:
    """Pairs (map_id, a, b, d2) taken in the order of (d2, a, b), each end once.

    Rounds of pairs that are first at both their ends: such a pair is what the
    ordered scan takes too, whatever else it does. Each round is two aggregations
    and takes away a large part of the pairs.
    """
    left, taken = materialize(pairs.select("map_id", "a", "b", "d2"), "pairs"), None
    while True:
        ends = left.select("map_id", F.inline(F.array(F.struct(F.col("a").alias("e"), "d2", "a", "b"), F.struct(F.col("b").alias("e"), "d2", "a", "b"))))
        first = ends.groupBy("map_id", "e").agg(F.min(F.struct("d2", "a", "b")).alias("m")).select("map_id", "e", "m.*")
        mutual = materialize(first.groupBy("map_id", "d2", "a", "b").count().filter("count = 2").drop("count"), "matched", rows=F.count(F.lit(1)))
        if not mutual.seen["rows"]:
            return taken if taken is not None else mutual.select("map_id", "a", "b", "d2")
        taken = mutual.select("map_id", "a", "b", "d2") if taken is None else taken.unionByName(mutual.select("map_id", "a", "b", "d2"))
        used = mutual.select("map_id", F.explode(F.array("a", "b")).alias("e"))
        left = materialize(left.join(used.withColumnRenamed("e", "a"), ["map_id", "a"], "left_anti").join(used.withColumnRenamed("e", "b"), ["map_id", "b"], "left_anti").select("map_id", "a", "b", "d2"), "pairs")


def radius_clusters(points: DataFrame, radius: float | Column, by: str = "map_id", order: str = "ord") -> DataFrame:
    """(by, cluster, x, y, dx, dy, n): greedy clusters by order, their mean place and direction.

    The first free point takes all free points within ``radius`` of itself, which may be a
    column that is the same for all points of a group; ``order`` is unique in a group. Directions are flipped to the side of the cluster's first one
    before the mean. Rounds of points with no free point before them in reach: the scan
    in order starts clusters there too. No group or neighbourhood is gathered; most
    points have nothing in reach and are in no round.
    """
    limit = radius if isinstance(radius, Column) else F.lit(float(radius))
    dots = materialize(points.select(by, order, "x", "y", "dx", "dy", limit.alias("limit")), "dots")
    box = ("x", "y", "x", "y")
    close = (F.col(f"l.{order}") < F.col(f"r.{order}")) & (F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y")) <= F.col("l.limit"))
    pairs = range_join(dots, dots, F.greatest(4 * F.col("limit"), F.lit(16.0)), close, pad=F.col("limit"), left_box=box, right_box=box, on=by)
    near = materialize(pairs.select(f"l.{by}", F.col(f"l.{order}").alias("a"), F.col(f"r.{order}").alias("b")), "near")
    left, rounds = near, []
    while True:
        first = left.select(by, "a").distinct().join(left.select(by, F.col("b").alias("a")), [by, "a"], "left_anti")
        new = materialize(left.join(first, [by, "a"], "left_semi").select(by, F.col("b").alias("e")).distinct(), "taken", rows=F.count(F.lit(1)))
        if not new.seen["rows"]:
            break
        rounds.append(new)
        if len(rounds) == 16:  # keeps the plan short
            rounds = [materialize(reduce(DataFrame.union, rounds), "taken")]
        left = materialize(left.join(new.withColumnRenamed("e", "a"), [by, "a"], "left_anti").join(new.withColumnRenamed("e", "b"), [by, "b"], "left_anti").select(by, "a", "b"), "near")
    taken = reduce(DataFrame.union, rounds or [new]).withColumnRenamed("e", order)
    seeds = dots.join(taken, [by, order], "left_anti").select(by, F.col(order).alias("seed"), F.col("dx").alias("sx"), F.col("dy").alias("sy"))
    # clusters of a map are numbered in the order of their seeds
    seeds = materialize(seeds.withColumn("cluster", F.row_number().over(Window.partitionBy(by).orderBy("seed"))), "seeds")
    # a point belongs to the first seed in reach
    owned = near.withColumnRenamed("a", "seed").join(seeds.select(by, "seed"), [by, "seed"], "left_semi").groupBy(by, F.col("b").alias(order)).agg(F.min("seed").alias("seed"))
    owned = owned.unionByName(seeds.select(by, F.col("seed").alias(order), "seed"))
    placed = dots.join(owned, [by, order]).join(seeds, [by, "seed"])
    side = F.when(F.col("dx") * F.col("sx") + F.col("dy") * F.col("sy") < 0, -1.0).otherwise(1.0)
    return placed.groupBy(by, "cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum(side * F.col("dx")).alias("dx"), F.sum(side * F.col("dy")).alias("dy"), F.count("*").alias("n"))


def ring_edges(points: DataFrame, by: list[str]) -> DataFrame:
    """Edges from each point of a ring to the next, and from the last to the first; points have `ord`, x, y."""
    w = Window.partitionBy(*by).orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return points.select(*by, "ord", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))
