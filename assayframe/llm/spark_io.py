"""Shared-folder tables and row keys for jobs of several passes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; every executor must reach it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at.rstrip("/")


#: Spark's own setting that deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again: later passes start there, also after lost executors.

    The folder goes when the driver's JVM ends, or with its scope (see scratch). Spark deletes the shuffle files of the job
    that wrote it as soon as it is written, so a chain of such jobs needs the disk of one.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if (own := _scope.get()) is not None:
        own.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of stage() that nothing reads any more, before the driver ends."""
    for t in tables:
        context = t.sparkSession.sparkContext
        p = context._jvm.org.apache.hadoop.fs.Path(t._staged_at)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


#: Tables staged in the innermost scope of this thread (or asynchronous task); other threads have their own.
_scope: ContextVar[list[DataFrame] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """A scope whose staged tables are deleted at its end, but for those that the yielded function was told to keep; an
    outer scope, if there is one, takes these over."""
    kept: list[DataFrame] = []
    made: list[DataFrame] = []
    outer = _scope.get()
    token = _scope.set(made)
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        _scope.reset(token)
        paths = {t._staged_at for t in kept if hasattr(t, "_staged_at")}
        discard(*[t for t in made if t._staged_at not in paths])
        if outer is not None:
            outer.extend(t for t in made if t._staged_at in paths)


def row_keys(doc_id: str, text: str) -> tuple[Column, Column]:
    """128 bits that tell rows apart by id and text; equal rows share them, and so share every result."""
    return F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(F.lit(7), text, doc_id).alias("r2")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
