"""Working tables in the folder that driver and executors share.

An operator that needs an intermediate result twice, or that iterates, writes
it here as Parquet and reads it back. That cuts the lineage in a way that
survives the loss of any executor, unlike cached or locally checkpointed rows.

The shuffle files of a written step are dropped as soon as it is done, and
tables that later steps no longer read can be discarded. What a lazy result
still reads stays until the application ends, when its folder is deleted.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_fallback: dict[str, str] = {}
_folders: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _fallback:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        _fallback[key] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _fallback[key]


def _path(spark: SparkSession, path: str):
    """The Hadoop path and the file system that holds it."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def application_folder(spark: SparkSession) -> str:
    """This application's folder under the shared root; its file system deletes it on exit."""
    folder = f"{shared_root(spark)}/tessera/{spark.sparkContext.applicationId}"
    if _folders.get(folder) is None:
        system, path = _path(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _folders[folder] = folder
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a working table and return a DataFrame that reads it.

    The write's own shuffle files are removed when it ends: nothing else reads
    them, as the returned DataFrame starts from the table.
    """
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    read = spark.read.schema(df.schema).parquet(path)
    read.working_path = path
    return read


def discard(*tables: DataFrame) -> None:
    """Delete working tables; only for those that no DataFrame still in use reads."""
    for table in tables:
        system, path = _path(table.sparkSession, table.working_path)
        system.delete(path, True)
