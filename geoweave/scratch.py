"""Session and scratch-table helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Paths of the tables made in each open scope, innermost last.
_scopes: list[list[str]] = []


def local_session(app: str = "geoweave", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``; without it, tables written by
    one executor would be out of reach of the others, so that is an error. Only a
    session whose one process is driver and executor makes a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str, outside: bool = False, **seen: Column) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: work that follows is recovered from the table when an
    executor is lost, and every later use reads only the columns that it needs.
    ``outside``: the table outlives the innermost ``scope``. Aggregates given as ``seen`` are
    observed while the rows are written, at no further pass, and are in the table's ``seen`` by name.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    watch = Observation() if seen else None
    (df.observe(watch, *(c.alias(k) for k, c in seen.items())) if watch else df).write.parquet(path)
    holders = _scopes[:-1] if outside else _scopes
    if holders:
        holders[-1].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    table.seen = watch.get if watch else {}
    return table


def forget(table: DataFrame) -> None:
    """Remove a materialized table that nothing reads any more."""
    _remove(table.sparkSession, table.scratch_path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are made inside are removed at the end; results must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)
