"""Sharding along a Hilbert curve over quantised metadata.

Size, source and language are quantised to ``BITS`` bits each by rank and give a cell
on the curve; rows are ordered by cell and cut into runs whose counts differ by one
at most (law `rows`). Shards then hold compact boxes of the metadata space, so
that a reader prunes files by their least and greatest values.

Sizes are ranked by rows, in steps of a quarter of a power of two. Sources and languages are
ranked in their own order among all distinct values: each has a bin of its own where there
are no more of them than bins, and otherwise shares it with its neighbours. Only the first
value of each bin reaches the driver.

No global sort is needed. Rows of each cell are counted first (a bounded number
of cells), and a cell is split into buckets by a hash of the id, so many that a
bucket holds about ``BUCKET_ROWS`` rows, up to ``MAX_BUCKETS``. A row's rank is the rows
of earlier cells, of earlier buckets of its cell, and its place in its bucket; a cell with
a third of all rows is spread over as many tasks as its size asks for. Equal rows that
are many are dealt to buckets by their place in the table.

Defined results: a null text has 0 bytes (size 1, checksum of nothing); null
sources and languages share the bin of the empty text. Repeated rows and rows without
an id take places like others. Equal texts get no special place under this law. Very
long texts are one row like any other. Columns are carried into the written shards
whatever their names: where one is called `shard` or `slot`, ours gets an underscore
behind it. An empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from geoweave.llm import ranks
from geoweave.llm.names import free
from geoweave.operators import skew
from geoweave.scratch import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS, DIMENSIONS = 4, 3
SHARDS = 16
BUCKET_ROWS, MAX_BUCKETS = 100, 4096


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of ``coordinates`` (n, dimensions), each below 2^bits.

    Axes are turned into the transposed index by undoing, from the highest bit
    down, the exchanges and inversions of the curve's sub-cubes; a Gray decode and
    interleaving of the bits follow.
    """
    x = coordinates.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where(x[n - 1] & (1 << b), t ^ ((1 << b) - 1), t)
    x ^= t
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> b & 1)
    return place


def value_of(column: str) -> Column:
    """A source or language as it is ordered in files: null comes first, with the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def size_of():
    return (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")


def size_step() -> Column:
    """Sizes in steps of a quarter of a power of two."""
    return F.floor(4 * F.log2(size_of())).cast("int")


def size_bins(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """(step, bin), some hundred rows at most: steps of the size by the rank of their rows."""
    seen = documents.groupBy(size_step().alias("step")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("step")) - F.col("n")
    return seen.select("step", F.floor(before * (1 << bits) / F.sum("n").over(Window.partitionBy())).cast("int").alias("bin"))


def first_values(documents: DataFrame, column: str, bits: int = BITS) -> list[str]:
    """The first value of each bin, in order: all distinct values cut into 2^bits runs of their order at most."""
    distinct = materialize(documents.select(F.lit(0).alias("all"), value_of(column).alias("value")).distinct(), "values")
    ranked = ranks.places(distinct, "all", F.col("value"))
    bin_of = F.expr(f"place * {1 << bits} div total")
    return [r["first"] for r in ranked.groupBy(bin_of.alias("bin")).agg(F.min("value").alias("first")).orderBy("bin").collect()]


def bin_of_value(column: str, firsts: list[str], bits: int = BITS) -> Column:
    """The last run that begins at or before the value; fewer runs than bins are spread over all bins."""
    begun = F.size(F.filter(F.array(*map(F.lit, firsts)).cast("array<string>"), lambda first: first <= value_of(column)))
    return F.floor((begun - 1) * (1 << bits) / max(1, len(firsts))).cast("int")


def cells(documents: DataFrame, bits: int = BITS, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, source, lang and the cell of every row; with ``carry`` also all its columns as ``row``."""
    text = F.coalesce("text", F.lit(""))
    found = materialize(size_bins(documents, bits), "bins")
    by_value = [bin_of_value(c, first_values(documents, c, bits), bits).alias(f"bin{k}") for k, c in enumerate(("source", "lang"), 1)]
    row = [F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")] if carry else []
    rows = documents.select(
        "doc_id", size_of().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        *row, size_step().alias("step"), *by_value,
    )
    rows = rows.join(F.broadcast(found.withColumnRenamed("bin", "bin0")), "step")
    whole = ["row"] if carry else []
    rows = rows.select("doc_id", "size", "text_crc32", "source", "lang", *whole, *(f"bin{k}" for k in range(DIMENSIONS)))
    schema = StructType([*rows.schema.fields[:5], StructField("cell", LongType()), *rows.schema.fields[5:-DIMENSIONS]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = hilbert_index(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[-DIMENSIONS:]], 1), bits)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(place), *b.columns[5:-DIMENSIONS]], names)

    return rows.mapInArrow(run, schema)


def shard(documents: DataFrame, shards: int = SHARDS, bits: int = BITS, bucket_rows: int = BUCKET_ROWS, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, cell, source and lang of every row; with ``carry`` also ``row``."""
    whole = ["row"] if carry else []
    rows = materialize(cells(documents, bits, carry).withColumn("seq", F.monotonically_increasing_id()), "cells")
    counted = rows.groupBy("cell").agg(F.count("*").alias("n"))
    # at most 2^(3 * bits) cells, whatever the number of rows
    order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counted.select("cell", (F.sum("n").over(order) - F.col("n")).alias("cell_start"), F.least(F.ceil(F.col("n") / bucket_rows), F.lit(MAX_BUCKETS)).cast("long").alias("buckets"), F.sum("n").over(Window.partitionBy()).alias("total"))
    # equal rows that are a large part of all: under skew.SHARE of them
    many = skew.limit_of(rows.count())
    equal = rows.groupBy("doc_id", "text_crc32").agg(F.count("*").alias("equal")).filter(F.col("equal") > many).select(F.col("doc_id").alias("id"), F.col("text_crc32").alias("crc"), F.lit(True).alias("equal"))
    placed = rows.join(F.broadcast(starts), "cell").join(F.broadcast(equal), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_crc32") == F.col("crc")), "left")
    dealt = F.when(F.col("equal"), F.xxhash64("seq")).otherwise(F.xxhash64("doc_id", "text_crc32"))
    placed = placed.withColumn("bucket", F.pmod(dealt, F.col("buckets"))).drop("id", "crc", "equal")
    in_cell = Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = placed.groupBy("cell", "bucket").agg(F.count("*").alias("n")).select("cell", "bucket", (F.sum("n").over(in_cell) - F.col("n")).alias("bucket_start"))
    in_bucket = Window.partitionBy("cell", "bucket").orderBy("doc_id", "text_crc32", "source", "lang", *map(F.xxhash64, whole), "seq")
    ranked = placed.withColumn("place", F.row_number().over(in_bucket) - 1).join(sizes, ["cell", "bucket"])
    # shard k holds ranks from ceil(k * total / shards) on
    ranked = ranked.withColumn("rank", F.col("cell_start") + F.col("bucket_start") + F.col("place")).withColumn("shard", F.expr(f"(rank * {shards}) div total").cast("int"))
    slot = F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").cast("long")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell", "source", "lang", *whole)


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write every row in files by shard, each in the order of the curve; several tasks may write one shard."""
    number, slot = free(documents.columns, "shard"), free(documents.columns, "slot")
    rows = shard(documents, shards, carry=True).select("row.*", F.col("shard").alias(number), F.col("slot").alias(slot))
    rows.repartitionByRange(number, slot).sortWithinPartitions(number, slot).write.partitionBy(number).parquet(path)
