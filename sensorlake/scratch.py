"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where it is unset, a local session (driver and executors are one process) gets a temporary folder of its own; on a
    cluster that folder would be another one on every machine, so the call fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        folder = _OWN["dir"]
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in a folder of this application, which Hadoop's file system deletes when the driver ends."""
    folder = f"{shared_folder(spark)}/scratch-{spark.sparkContext.applicationId}"
    if folder not in _OWN:
        files, path = _files(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWN[folder] = folder
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


@contextmanager
def _shuffles_end_with_the_write(spark: SparkSession) -> Iterator[None]:
    """What is written needs its shuffle files no more, so Spark drops them as the write ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: later steps start from the files,
    so a lost executor costs no more than the step it was in."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_end_with_the_write(spark):
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that no later step reads."""
    for table in tables:
        discard(table.sparkSession, table.scratch_path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files through the file system that it is in."""
    files, folder = _files(spark, path)
    files.delete(folder, True)


class BucketedTable:
    """A written table whose rows lie in hash buckets of a key, each bucket in one sorted file: joins and
    aggregates on the key read it without a shuffle.  `at` and `named` put it at a path of the caller's."""

    def __init__(self, df: DataFrame | None, name: str, key: str, buckets: int, spark: SparkSession | None = None, at: str | None = None,
                 schema: str | None = None):
        """Writes df; with df None, registers the files that an earlier session has written at `at` with that schema."""
        self.spark = df.sparkSession if df is not None else spark
        self.key, self.buckets = key, buckets
        self.path, self.table = at or scratch_path(self.spark, name), f"scratch_{uuid.uuid4().hex}"
        if df is not None:
            self.schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
            dealt = df.repartition(buckets, key)
            with _shuffles_end_with_the_write(self.spark):
                dealt.write.option("path", self.path).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(self.table)
        else:
            self.schema = schema
            self.spark.sql(f"CREATE TABLE {self.table} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                           f"INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def unregister(self) -> None:
        """Leaves the files and takes the name out of the catalog."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def drop(self) -> None:
        self.unregister()
        discard(self.spark, self.path)
