"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.session import checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_WORKING: ContextVar[list[str] | None] = ContextVar("working_tables", default=None)  # of the thread's pipeline stage


@contextmanager
def working_tables() -> Iterator[list[str]]:
    """Collects the paths that :func:`stash` writes inside the block, in its thread."""
    paths: list[str] = []
    token = _WORKING.set(paths)
    try:
        yield paths
    finally:
        _WORKING.reset(token)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        fs, at = _file_system(spark, paths.pop())
        fs.delete(at, True)


def stash(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows reads committed files that every executor
    sees, so a lost executor costs a re-read and never a recomputation. The table
    goes when the driver ends, or earlier by :func:`delete_tables`.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)  # the session's codec unless one is named
    fs, at = _file_system(df.sparkSession, path)
    fs.deleteOnExit(at)
    if (made := _WORKING.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator], Iterator], *forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """``run`` of a Python task, after which the worker gives back what it held: memos by
    ``forget``, then the free memory of Arrow's pool and of the C heap."""
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa
            for f in forget:
                f()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)
    return task


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(c: str | Column) -> Column:
    """The text, null as empty."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit(""))

