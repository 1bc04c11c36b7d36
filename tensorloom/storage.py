"""Shared storage: the folder that driver and executors both see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset, in local mode, a temporary folder. A cluster without it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="tensorloom-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that Spark's file systems reach; nothing, if it isn't there."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it Spark deletes a query's shuffle files when the query has ended: for jobs that write each step and read it again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_passing: ContextVar[dict[str, DataFrame] | None] = ContextVar("passing", default=None)


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and scan it: cuts the lineage, survives lost executors.

    Within ``scratch`` the table goes at its end, unless ``keep``.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if not keep and (passing := _passing.get()) is not None:
        passing[path] = out
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """Deletes at its end the tables that were materialized in it: what outlives it is collected or written with ``keep``.

    Gives a function that deletes one of them before.
    """
    held = _passing.set({})
    passing = _passing.get()

    def drop(table: DataFrame) -> None:
        for path in [p for p, t in passing.items() if t is table]:
            delete(spark, path)
            del passing[path]

    try:
        yield drop
    finally:
        for path in passing:
            delete(spark, path)
        _passing.reset(held)
