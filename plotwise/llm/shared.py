"""Folders that all executors see, and batch cutting for Arrow jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import IntegralType


def integer_ids(docs: DataFrame) -> Column:
    """doc_id as a long; the operators that order documents by it take integers only."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be of an integer type here, not {kind.simpleString()}")
    return docs["doc_id"].cast("long").alias("doc_id")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir.  Only where that is unset and all runs on one machine (tests) a temporary one is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def passing(spark: SparkSession, folder: str) -> str:
    """The folder, marked to be deleted when the driver ends."""
    path, files = _path(spark, folder)
    files.deleteOnExit(path)
    return folder


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it has in it."""
    return "`" + name.replace("`", "``") + "`"


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows, written to the shared folder (in folders `by` columns) and read again: a cut in the lineage that no executor's loss undoes.

    Columns are written under names of their places, so that any names will do."""
    folder = shared_folder(df.sparkSession, name)
    placed = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    placed.write.option("compression", "zstd").partitionBy(*(f"c{df.columns.index(c)}" for c in by)).parquet(folder)
    return df.sparkSession.read.schema(placed.schema).parquet(passing(df.sparkSession, folder)).select(placed.columns).toDF(*df.columns)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a table that has been replaced."""
    path, files = _path(spark, folder)
    files.delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none has more than so many bytes in the column; a longer text comes alone."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rest = batch.slice(at)
            size = rest.column(column).nbytes
            rows = batch.num_rows - at
            while rows > 1 and size > most:
                rows = max(1, min(rows - 1, int(rows * most / size)))
                size = rest.column(column).slice(0, rows).nbytes
            yield rest.slice(0, rows)
            at += rows
