"""Places of rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.scratch import materialize


def places(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with ``place`` (from 0) and ``total`` (rows) within each value of ``group``, null being a value.

    Rows are cut into sorted ranges and written; a row's place is the rows of its
    group in earlier ranges and its distance from the group's first row in its own.
    A group with a third of all rows lies in many ranges. ``rows`` should be a written
    table, as the ranges are sampled first, and ``order`` should tell apart rows that are
    many, or they share one range.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__seq", F.monotonically_increasing_id())
    laid = materialize(laid.withColumn("__range", F.shiftright("__seq", 33)), "laid")
    counts = laid.groupBy(group, "__range").agg(F.count("*").alias("__n"), F.min("__seq").alias("__first"))
    # a row for each range that a group lies in
    whole = Window.partitionBy(group)
    before = F.sum("__n").over(whole.orderBy("__range")) - F.col("__n")
    starts = counts.select(
        F.col(group).alias("__group"), F.col("__range").alias("__of"), (before - F.col("__first")).alias("__start"),
        F.sum("__n").over(whole).alias("total"),
    )
    met = laid.join(starts, (F.col("__range") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")))
    return met.select(*rows.columns, (F.col("__start") + F.col("__seq")).alias("place"), "total")
