"""Cutting lineage so that lost executors cost no recomputation from the start."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders that go when the driver ends.
_going: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Lets the shuffle files of a query go when it ends, not when the driver next collects garbage: for queries whose
    result is written, and so isn't computed from those files again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """The application's folder in the cluster's spark.checkpoint.dir, which goes with the application. Only a local session
    that names none gets a folder of its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    path = context._jsc.sc().getCheckpointDir().get()  # of this application alone
    if path not in _going:
        files, at = file_system(spark, path)
        files.deleteOnExit(at)
        _going.add(path)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of path and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there."""
    files, at = file_system(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = file_system(spark, path)
    return files.exists(at)


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written to a new folder and reread."""
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lasting(df: DataFrame) -> DataFrame:
    """df, computed once and reread from Parquet files that all executors share.

    Unlike a checkpoint, which keeps the size that its plan was guessed to have (a
    product over all joins, so it explodes in loops), a written table has its true
    size: Spark broadcasts it only when small, and later readers take the columns
    they need. Partitions and the order of rows aren't kept. The files stay until the application ends.
    """
    return written(df, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}")


class Scratch:
    """Tables kept as lasting keeps them, and deleted together when the block ends, or one by one before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        kept = written(df, path)
        self.paths[id(kept)] = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for table in tables:
            delete(self.spark, self.paths.pop(id(table)))


def lasting_in_order(df: DataFrame) -> DataFrame:
    """df, computed once and kept with its partitions and their order of rows, as a checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
