"""Bounded samples whose rows are chosen by a hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, limit: int, keys: DataFrame | None = None) -> list[Row]:
    """``limit`` rows of ``df``, or all if there are fewer: those with the least hashes of all columns.

    Rows are first thinned to about 1.2 times ``limit`` by a bound on the hash, so that
    the final sort sees a bounded number of rows however many tasks there are. Where
    repeated rows thin to fewer than ``limit``, the sort sees ``limit`` of each task.
    ``keys`` is what to count for that bound, if it is cheaper than ``df``.
    """
    span = 1 << 40
    rows = (df if keys is None else keys).count()
    place = F.pmod(F.xxhash64(*df.columns), F.lit(span))
    least = lambda some: some.withColumn("__place", place).orderBy("__place", *df.columns).limit(limit).drop("__place").collect()
    thin = int(span * min(1.0, 1.2 * limit / max(rows, 1)))
    taken = least(df.filter(place < F.lit(thin)) if rows > limit else df)
    return taken if len(taken) >= min(limit, rows) else least(df)
