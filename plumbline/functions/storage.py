"""Running actions, and where intermediate results are kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, a folder of the warehouse."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/plumbline-checkpoints")
    return context.getCheckpointDir()


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Delete, at the end of the block, the intermediate tables that were written inside it.

    Frames and reports made inside read those tables, so use or write them before the end.
    """
    written: list[tuple[SparkSession, str]] = []
    _scopes.append(written)
    try:
        yield
    finally:
        _scopes.remove(written)
        for spark, path in written:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _storable(kind: T.DataType) -> bool:
    """Can a parquet column hold it?"""
    if isinstance(kind, T.StructType):
        return all(_storable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return not isinstance(kind, T.NullType | T.VariantType | T.CalendarIntervalType)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = Lock()
_cleaners = 0
_given: str | None = None


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of what is written inside once it is written; nothing reads them."""
    global _cleaners, _given
    with _cleaning:
        _cleaners += 1
        if _cleaners == 1:
            _given = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning:
            _cleaners -= 1
            if not _cleaners and _given is None:
                spark.conf.unset(CLEANUP)
            elif not _cleaners:
                spark.conf.set(CLEANUP, _given)


def pin(df: DataFrame) -> DataFrame:
    """Compute a frame once and cut its lineage; survives the loss of executors.

    Written as a table to the shared folder: unlike ``checkpoint()`` that runs
    the last stage once, not twice, and later reads take only the columns they
    need. Frames parquet cannot hold are checkpointed.
    """
    spark = df.sparkSession
    if all(_storable(f.dataType) for f in df.schema) and len(set(df.columns)) == len(df.columns):
        path = f"{shared_folder(spark)}/pinned-{uuid.uuid4().hex}"
        for written in _scopes[-1:]:
            written.append((spark, path))
        with _without_leftovers(spark):
            df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def together(spark: SparkSession, *actions: Callable[[], Any]) -> list[Any]:
    """Start independent Spark actions at once, so that small ones share the cluster."""
    with ThreadPoolExecutor(len(actions)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(action)) for action in actions]
        return [job.result() for job in started]


def spread(df: DataFrame, rows: int, rows_per_task: int = 5_000) -> DataFrame:
    """Give a small table to all cores before Python works on it.

    A file of a few megabytes is one input split, that is one task. Tables with
    more rows have splits enough and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows > cores * 50 * rows_per_task:
        return df
    return df.repartition(max(1, min(cores, rows // rows_per_task)))


def python_tasks(df: DataFrame, groups: int) -> int:
    """Number of tasks for grouped Python work.

    Grouped data of a few megabytes would be merged into one task by size,
    although the work per byte is heavy; a stated number is kept.
    """
    return max(1, min(groups, 4 * df.sparkSession.sparkContext.defaultParallelism))
