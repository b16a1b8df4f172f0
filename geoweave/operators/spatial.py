"""Range joins on a grid: theta joins of boxes as equality joins on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reaching(rows: DataFrame, base: float, scales: DataFrame | None = None, least: float = 0.0, name: str = "reach") -> DataFrame:
    """``rows`` with a column ``reach``: ``base``, times the factor f of the row's map where ``scales`` (map_id, f) has one."""
    if scales is None:
        return rows.withColumn(name, F.lit(float(base)))
    by_map = scales.select("map_id", F.greatest(F.lit(float(least)), F.col("f") * base).alias(name))
    return rows.join(by_map, "map_id", "left").withColumn(name, F.coalesce(name, F.lit(float(base))))


def with_cells(df: DataFrame, cell: float | Column, pad: float | Column = 0.0, box: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """A row for each grid cell that a row's box, padded, touches: gx, gy, and the least cell (gx0, gy0)."""
    a, b, c, d = (F.col(x) for x in box)
    lo_x, hi_x = F.floor((F.least(a, c) - pad) / cell), F.floor((F.greatest(a, c) + pad) / cell)
    lo_y, hi_y = F.floor((F.least(b, d) - pad) / cell), F.floor((F.greatest(b, d) + pad) / cell)
    wide = df.withColumns({"gx0": lo_x, "gy0": lo_y, "__x": F.sequence(lo_x, hi_x), "__y": F.sequence(lo_y, hi_y)})
    return wide.withColumn("gx", F.explode("__x")).withColumn("gy", F.explode("__y")).drop("__x", "__y")


def range_join(left: DataFrame, right: DataFrame, cell: float | Column, predicate: Column, pad: float | Column = 0.0, left_box=("x1", "y1", "x2", "y2"), right_box=("x1", "y1", "x2", "y2"), on: str = "map_id", cells: bool = False) -> DataFrame:
    """Rows l of ``left`` and r of ``right`` of one map whose boxes come within ``pad`` and that meet ``predicate``.

    A pair that shares several cells is reported in the least of them only, so no
    distinct is needed. The result has struct columns l and r. ``pad`` may be a column of ``left``; ``cell`` may
    be an expression over columns of both sides that is the same for all rows of a map, so that maps of
    unlike extent each have a grid of their own in one join. With ``cells`` a pair keeps the cell that it is reported in
    (map, gx, gy), by which it lies in its task: what is grouped by it and more is not shuffled again.
    """
    names = lambda df: [F.col(f"`{c}`") for c in df.columns]
    a = with_cells(left, cell, pad, left_box).select(F.struct(*names(left)).alias("l"), "gx", "gy", F.col("gx0").alias("lx"), F.col("gy0").alias("ly"), F.col(on).alias("__map"))
    b = with_cells(right, cell, 0.0, right_box).select(F.struct(*names(right)).alias("r"), "gx", "gy", F.col("gx0").alias("rx"), F.col("gy0").alias("ry"), F.col(on).alias("__map"))
    first = (F.col("gx") == F.greatest("lx", "rx")) & (F.col("gy") == F.greatest("ly", "ry"))
    # the planner sees neither the rows of cells nor the pairs, and would broadcast a side by its columns' estimate
    joined = a.join(b.hint("merge"), ["__map", "gx", "gy"]).filter(first).filter(predicate)
    return joined.select("l", "r", *([F.col("__map").alias("map"), "gx", "gy"] if cells else []))
