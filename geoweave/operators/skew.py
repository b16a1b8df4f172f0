"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.scratch import materialize

#: A key is heavy with more than one of so many of all rows: there are fewer heavy keys than this.
SHARE = 1000
#: Rows of one key that need no spreading in any table.
LEAST = 1000


def limit_of(rows: int) -> int:
    """Rows that a key may have of ``rows`` in all without being heavy."""
    return max(rows // SHARE, LEAST)


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, parts): the heavy keys, under ``SHARE`` of them, and how many parts their rows are dealt into."""
    most = limit_of(rows.count())
    return materialize(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("parts")), "heavy")


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, heavy: DataFrame) -> DataFrame:
    """Inner join of ``many`` with ``one`` (a row for each key); a heavy key's rows are dealt by a hash of ``by``.

    ``heavy`` has a bounded number of rows, so it is broadcast; its keys' rows of
    ``one`` are repeated for every part.
    """
    heavy = F.broadcast(heavy)
    parts = F.coalesce("parts", F.lit(1))
    dealt = many.join(heavy, key, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    copies = one.join(heavy, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(copies.hint("merge"), [key, "__part"]).drop("__part")
