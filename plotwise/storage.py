"""Folders that the driver and all executors see, and small files in them, by whatever file system Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir.  Only where that is unset and all runs on one machine (tests) a temporary one is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def passing(spark: SparkSession, folder: str) -> str:
    """The folder, marked to be deleted when the driver ends."""
    path, files = _path(spark, folder)
    files.deleteOnExit(path)
    return folder


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows, written to the shared folder (in folders `by` columns) and read again: a cut in the lineage that no executor's loss undoes."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(passing(df.sparkSession, folder)).select(df.columns)


def bucketed(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """The rows, written to the shared folder in buckets of a column: grouping by it, or joining on it, shuffles nothing of them."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    folder = shared_folder(spark, name)
    df.write.option("compression", "zstd").option("path", folder).bucketBy(buckets, column).sortBy(column).saveAsTable(table)
    passing(spark, folder)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the files of such a table stay
    return rows


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows that the plan reads, added up over its leaves."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(size for size in sizes if size < 1 << 60)  # beyond that Spark says that it doesn't know


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a table that has been replaced."""
    path, files = _path(spark, folder)
    files.delete(path, True)


def keep_only(spark: SparkSession, folder: str, names: set[str]) -> None:
    """Delete the files of a folder that have none of the names; the folder is made if nothing was written."""
    path, files = _path(spark, folder)
    files.mkdirs(path)
    for status in files.listStatus(path):
        if status.getPath().getName() not in names:
            files.delete(status.getPath(), True)


def exists(spark: SparkSession, name: str) -> bool:
    path, files = _path(spark, name)
    return files.exists(path)


def move(spark: SparkSession, source: str, dest: str) -> None:
    """Rename a folder; fails if the destination is there."""
    (a, files), (b, _) = _path(spark, source), _path(spark, dest)
    files.mkdirs(b.getParent())
    if files.exists(b) or not files.rename(a, b):
        raise FileExistsError(dest)


def write_small(spark: SparkSession, name: str, text: str) -> None:
    path, files = _path(spark, name)
    stream = files.create(path, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
