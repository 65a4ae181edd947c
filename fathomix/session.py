"""Spark session set-up and lineage cutting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()
_SCOPES: list[list[DataFrame]] = []


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **settings: str,
) -> SparkSession:
    """A session with UTC times and adaptive execution; the caller's settings win.

    Leave ``master`` and ``shuffle_partitions`` unset on a cluster, where the submitter
    chooses them.
    """
    builder = (
        SparkSession.builder.appName("fathomix")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, or below the warehouse.

    Both are shared by the executors. The folder is deleted when the application ends.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate")
    folder = context.getCheckpointDir()
    if folder not in _FOLDERS:
        fs, path = _file_system(spark, folder)
        fs.deleteOnExit(path)
        _FOLDERS.add(folder)
    return folder


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    The copy outlives lost executors, and everything derived from it sees the same rows
    however often a stage is retried. It is columnar, so later steps read only the columns
    they use, and its size is known to the optimizer. ``release`` deletes it early, a
    surrounding ``intermediates`` block deletes it at its end, and the end of the
    application deletes whatever is left.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    if _SCOPES:
        _SCOPES[-1].append(stored)
    return stored


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialize`` and the number of rows, which the written files already state."""
    stored = materialize(df)
    return stored, stored.count()


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made and nothing reads any more."""
    for table in tables:
        fs, path = _file_system(table.sparkSession, table._stored_at)
        fs.delete(path, True)


@contextmanager
def intermediates() -> Iterator[None]:
    """Delete the tables that ``materialize`` makes inside the block when the block ends.

    Run the actions on a job's results inside the block.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        release(*_SCOPES.pop())
