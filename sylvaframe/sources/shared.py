"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import copy
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark drops the shuffle files of a finished write at once instead of when its plan is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A folder of this machine stands in only for a local master, as in tests."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sylvaframe-")
        context.setCheckpointDir(path)
        atexit.register(remove, spark, path)
    return path.rstrip("/")


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; the lineage ends there and survives lost executors.

    replaces is an earlier stored table that is no longer read once this one is written; it is deleted. What is left is deleted
    when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with _dropping_shuffles(spark):
        df.write.parquet(path)
    atexit.register(remove, spark, path)
    for tables in _collecting.get():
        tables.append(path)
    if replaces is not None:
        drop(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


_collecting: ContextVar[tuple[list[str], ...]] = ContextVar("collecting", default=())


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that this thread stores inside the block; those of other threads are theirs."""
    tables: list[str] = []
    before = _collecting.set((*_collecting.get(), tables))
    try:
        yield tables
    finally:
        _collecting.reset(before)


def owner_of(df: DataFrame, tables: list[str]) -> DataFrame:
    """df, with whose Python object and those derived from it tables are deleted; keep one of them until its rows are read.
    A temporary view is not one of them: keep the frame beside it, or store it.

    Derived frames hand on the session object, so a copy of it that only they hold tells when the last one is gone.
    """
    spark = df.sparkSession
    own = copy.copy(spark)
    weakref.finalize(own, _remove_all, spark, tables)
    return type(df)(df._jdf, own)


def _remove_all(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        remove(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop(table: DataFrame) -> None:
    """Delete a stored table that no plan reads any more."""
    if path := getattr(table, "_stored_at", None):
        remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder is temporary anyhow
        pass
