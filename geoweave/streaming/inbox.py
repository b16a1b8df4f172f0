"""From a folder of pages to a table, as a stream: each content once, each batch written once.

A folder is watched by a file stream. Pages that are too large are left out; of pages of equal content,
in one batch or many, one goes on: the keys seen are the stream's state, and only path, key and length
are shuffled to it, never the content. Batches are written to folders named by their numbers, so one
that is run again after a failure or a restart takes the place of what it wrote before.

Defined results: empty content is a page like others, but Spark reads no file of no bytes, so such files
do not arrive; rows without content are no pages. An empty folder gives an empty table. Of equal pages in one batch any one may stand for the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geoweave.sources.ingest import content_key

PAGE_FILE = "path string, modificationTime timestamp, length long, content binary"
MOST_BYTES = 25 << 20
#: The column that batches are told apart by, in folders.
BATCH = "batch_id"


def watch_folder(spark: SparkSession, folder: str, pattern: str = "*.pdf", files_per_batch: int = 1000) -> DataFrame:
    """(path, content): the files of a folder as they arrive, each once."""
    files = spark.readStream.format("binaryFile").schema(PAGE_FILE).option("pathGlobFilter", pattern)
    return files.option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "content")


def new_pages(pages: DataFrame, most_bytes: int = MOST_BYTES, remember: str | None = None) -> DataFrame:
    """(path, key, length) of the first page of each content.

    Pages: path, content, and `arrived` where ``remember`` is given. Keys are kept for good, or, with
    ``remember`` ("30 days"), for that long after a page arrived, so that the state stays bounded.
    """
    fit = pages.filter(F.octet_length("content") <= most_bytes)
    columns = ["path", content_key(F.col("content")).alias("key"), F.octet_length("content").cast("long").alias("length")]
    if remember is None:
        return fit.select(*columns).dropDuplicates(["key"])
    keyed = fit.select(*columns, "arrived").withWatermark("arrived", remember)
    return keyed.dropDuplicatesWithinWatermark(["key"]).drop("arrived")


def deliver(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream's batches below ``path``; ``trigger`` is that of ``writeStream``, for instance availableNow=True."""
    spark = stream.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def delivered(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that ``deliver`` has written, with the number of their batch."""
    return spark.read.schema(schema).option("basePath", path).parquet(path)
