"""Label readings: repair, confidence, positional folds, the best for each text.

The folds depend on the order of readings (`ord`), so each map's readings are
folded in order. Only readings that are close on both axes can act on each other: a
fold runs over a chain, and a map is cut into chains wherever a gap along x, then along
y, and so on in turns, is out of reach. Where a map has no such gap, a chain is as long
as the map's readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions import geometry as g
from geoweave.functions import labels as fl
from geoweave.operators.clusters import cut_at_gaps
from geoweave.operators.spatial import range_join


def load(readings: DataFrame) -> DataFrame:
    """Repaired, valid and confident readings."""
    repaired = readings.withColumn("text", fl.repair("text"))
    return repaired.filter(fl.valid(F.col("text"))).filter(fl.confident())


def load_plain(readings: DataFrame) -> DataFrame:
    """Valid and confident readings as they are, without repair."""
    return readings.filter(fl.valid(F.col("text"))).filter(fl.confident())


def load_sure(readings: DataFrame, least: float = 0.75) -> DataFrame:
    """The older loader: trimmed readings that the builder's pattern accepts, with a confidence of ``least``."""
    return readings.withColumn("text", F.trim("text")).filter(fl.valid(F.col("text"), fl.BUILDER) & (F.col("conf") >= least))


def build(passes: list[DataFrame], second: DataFrame | None = None) -> DataFrame:
    """A map's readings from all passes: merged, gaps filled by a second reader, repaired, and one for each place."""
    merged = passes[0]
    for p in passes[1:]:
        merged = merged.unionByName(p)
    merged = merge_passes(merged)
    if second is not None:
        merged = fill_gaps(merged, second)
    return positional_dedup(merged.withColumn("text", fl.repair_reading(F.col("text"))))


def along_route(labels: DataFrame, route: DataFrame, reach: float = 200.0) -> DataFrame:
    """Adds `s`: how far along the route the nearest point of it lies; x itself beyond ``reach``, or without a route.

    The route's segments are taken in the order of seg_id; of equally near ones the first counts.
    """
    w = Window.partitionBy("map_id").orderBy("seg_id").rowsBetween(Window.unboundedPreceding, -1)
    run = route.withColumn("len", g.length()).withColumn("start", F.coalesce(F.sum("len").over(w), F.lit(0.0)))
    # a route's segments are dealt to all cells that they are near to, so a label's pairs lie in its own cell
    d = g.point_segment_distance("r.x", "r.y", "l.x1", "l.y1", "l.x2", "l.y2")
    near = range_join(run.select("map_id", "seg_id", "start", "x1", "y1", "x2", "y2"), labels.select("map_id", "label_ord", "x", "y"), reach, d <= reach, pad=reach, right_box=("x", "y", "x", "y"))
    places = [F.col(c).cast("double").alias(c[2:]) for c in ("l.start", "r.x", "r.y", "l.x1", "l.y1", "l.x2", "l.y2")]
    few = nearest_in_batches(near.select("r.map_id", "r.label_ord", "l.seg_id", d.alias("d"), *places)).withColumn("r", F.struct("x1", "y1", "x2", "y2"))
    u, _, n = g.strip_frame("r", "x", "y")
    at = F.col("start") + F.coalesce(F.greatest(F.lit(0.0), F.least(u, n)), F.lit(0.0))
    best = few.groupBy("map_id", "label_ord").agg(F.min(F.struct("d", "seg_id", at.alias("s"))).alias("m")).select("map_id", "label_ord", F.col("m.s").alias("at"))
    return labels.join(best, ["map_id", "label_ord"], "left").withColumn("s", F.coalesce("at", F.col("x").cast("double"))).drop("at")


def nearest_in_batches(pairs: DataFrame) -> DataFrame:
    """Pairs (map_id, label_ord, seg_id, d, ...) without those that are not the nearest of their label in their batch, of equals the first.

    The pairs of a cell follow each other, so little more than a row for each label is left to be sorted and grouped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            map_id, label = (batch.column(k).dictionary_encode().indices.to_numpy() for k in (0, 1))
            order = np.lexsort((batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(), label, map_id))
            map_id, label = map_id[order], label[order]
            new = np.r_[True, (map_id[1:] != map_id[:-1]) | (label[1:] != label[:-1])][: len(order)]
            yield batch.take(pa.array(order[new]))

    return pairs.mapInArrow(run, pairs.schema)


def best_per_text(labels: DataFrame) -> DataFrame:
    """One label for each map and text: the most confident, the first of equals."""
    top = F.max_by(F.struct("label_ord", "conf", "x", "y"), F.struct(F.col("conf"), -F.col("label_ord")))
    return labels.groupBy("map_id", "text").agg(top.alias("b")).select("map_id", "text", "b.label_ord", "b.conf", "b.x", "b.y")


def closest_per_text(labels: DataFrame, distance: str = "dist") -> DataFrame:
    """One label for each map and text: the one nearest to the route, the first of equals."""
    top = F.min_by(F.struct("label_ord", "conf", "x", "y", distance), F.struct(F.col(distance), F.col("label_ord")))
    return labels.groupBy("map_id", "text").agg(top.alias("b")).select("map_id", "text", "b.label_ord", "b.conf", "b.x", "b.y", f"b.{distance}")


def one_per_face(labels: DataFrame) -> DataFrame:
    """One label for each face: the most confident, then the longest text, then the first."""
    w = Window.partitionBy("map_id", "face_id").orderBy(F.desc("conf"), F.desc(F.length("text")), "label_ord")
    return labels.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def chains(readings: DataFrame, reach: float) -> DataFrame:
    """Adds `chain`: no two readings of different chains of a map are within ``reach`` on both axes."""
    return cut_at_gaps(readings, reach)


def fold(readings: DataFrame, reach: float, step, start: Column | None = None) -> DataFrame:
    """The readings that an ordered fold keeps; ``step(kept, reading)`` gives the new array of kept ones."""
    row = F.struct("ord", "text", "conf", "x", "y", "source")
    runs = chains(readings, reach).groupBy("map_id", "chain").agg(F.array_sort(F.collect_list(row)).alias("run"))
    kept = F.aggregate("run", F.filter("run", lambda r: F.lit(False)), step)
    return runs.select("map_id", F.inline(kept))


def _replace_first(kept: Column, at: Column, reading: Column) -> Column:
    return F.transform(kept, lambda k, i: F.when(i == at, reading).otherwise(k))


def _first_index(flags: Column) -> Column:
    return F.array_position(flags, True).cast("int") - 1


def dominates(a: Column, b: Column) -> Column:
    """Reading a makes b superfluous: the same text at least as sure, a parcel's part, or the whole of a fragment."""
    rest = F.substr(a["text"], (F.length(b["text"]) + 1).cast("int"))
    longer = F.startswith(a["text"], b["text"]) & (F.length(a["text"]) > F.length(b["text"]))
    fragment = (F.length(b["text"]) <= 2) & ~F.contains(b["text"], F.lit("/")) & rest.rlike("^[0-9]+$")
    return F.when(a["text"] == b["text"], a["conf"] >= b["conf"]).otherwise(longer & (F.startswith(rest, F.lit("/")) | fragment))


def positional_dedup(readings: DataFrame, near: float = 20.0, same: float = 5.0) -> DataFrame:
    """Readings of one number at one place become one; at the very same place the surer stays."""

    def step(kept: Column, new: Column) -> Column:
        def action(k: Column) -> Column:
            dx, dy = F.abs(new["x"] - k["x"]), F.abs(new["y"] - k["y"])
            close = (dx < near) & (dy < near)
            at = (dx < same) & (dy < same)
            return F.when(~close, 0).when(dominates(k, new), 1).when(dominates(new, k), 2).when(at & (k["conf"] >= new["conf"]), 1).when(at, 2).otherwise(0)

        actions = F.transform(kept, action)
        first = _first_index(F.transform(actions, lambda x: x > 0))
        return F.when(first < 0, F.concat(kept, F.array(new))).when(F.get(actions, first) == 1, kept).otherwise(_replace_first(kept, first, new))

    return fold(readings, near, step)


def merge_passes(readings: DataFrame, near: float = 30.0) -> DataFrame:
    """Readings of several passes: of one text within ``near`` on both axes, the surer stays in the place of the first."""

    def step(kept: Column, new: Column) -> Column:
        same = F.transform(kept, lambda k: (k["text"] == new["text"]) & (F.abs(k["x"] - new["x"]) < near) & (F.abs(k["y"] - new["y"]) < near))
        first = _first_index(same)
        return F.when(first < 0, F.concat(kept, F.array(new))).when(new["conf"] > F.get(kept, first)["conf"], _replace_first(kept, first, new)).otherwise(kept)

    return fold(readings, near, step)


def merge_chunks(readings: DataFrame, near_x: float = 50.0, near_y: float = 30.0) -> DataFrame:
    """Readings of overlapping chunks: at one place the longer text stays, of equal length the surer."""

    def step(kept: Column, new: Column) -> Column:
        close = F.transform(kept, lambda k: (F.abs(k["x"] - new["x"]) < near_x) & (F.abs(k["y"] - new["y"]) < near_y))
        first = _first_index(close)
        k = F.get(kept, first)
        better = (F.length(new["text"]) > F.length(k["text"])) | ((F.length(new["text"]) == F.length(k["text"])) & (new["conf"] > k["conf"]))
        return F.when(first < 0, F.concat(kept, F.array(new))).when(better, _replace_first(kept, first, new)).otherwise(kept)

    return fold(readings, near_x, step)


def fill_gaps(primary: DataFrame, second: DataFrame, near: float = 40.0, least: float = 0.3) -> DataFrame:
    """Primary readings, and valid ones of a second reader that no valid reading kept so far is near.

    Accepted readings join the kept ones, so this is a fold as well: primary
    readings come first.
    """
    usable = second.filter(F.col("conf") >= least).filter(fl.valid(F.col("text"), fl.BUILDER))
    both = primary.withColumn("pass", F.lit(0)).unionByName(usable.withColumn("pass", F.lit(1)))
    row = F.struct("pass", "ord", "text", "conf", "x", "y", "source")
    runs = chains(both, near).groupBy("map_id", "chain").agg(F.array_sort(F.collect_list(row)).alias("run"))

    def step(kept: Column, new: Column) -> Column:
        taken = F.exists(kept, lambda k: fl.valid(k["text"], fl.BUILDER) & (F.abs(k["x"] - new["x"]) < near) & (F.abs(k["y"] - new["y"]) < near))
        return F.when((new["pass"] == 0) | ~taken, F.concat(kept, F.array(new))).otherwise(kept)

    return runs.select("map_id", F.inline(F.aggregate("run", F.filter("run", lambda r: F.lit(False)), step))).drop("pass")
