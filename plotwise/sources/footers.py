"""Parquet footers as tables. Spark gives neither key-value metadata nor row-group statistics, so tasks parse footers; no row is read.

The list of files is a DataFrame and is dealt to tasks.  Where Arrow knows the file system (local, S3, GCS, Azure, HDFS) a task reads the end of
each file alone.  Any other store is read through Spark's binary reader, with a file's bytes in one task's memory, so files should be
partition-sized there."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIRECT = {"": "file", "file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}
KEYS = ("geo", "license", "attribution", "redistribution")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path as Spark writes it, and the path in it."""
    parts = urlsplit(path)
    scheme = _DIRECT[parts.scheme]
    return fs.FileSystem.from_uri(f"file://{parts.path}" if scheme == "file" else f"{scheme}://{parts.netloc}{parts.path}")


def readable_by_tasks(listed: DataFrame) -> bool:
    """Whether Arrow knows the file system of the files (path)."""
    first = listed.select("path").first()
    return first is None or urlsplit(first["path"]).scheme in _DIRECT


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): content is null, and never read, where tasks can open the file themselves."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return listed.select("path", F.lit(None).cast("binary").alias("content") if readable_by_tasks(listed) else "content")


def _footer(path: str, content: bytes | None) -> pq.FileMetaData:
    if content is not None:
        return pq.read_metadata(io.BytesIO(content))
    files, name = file_system(path)
    with files.open_input_file(name) as source:
        return pq.read_metadata(source)


def _inventory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            meta = _footer(path, content)
            keys = {k.decode(errors="replace"): v.decode(errors="replace") for k, v in (meta.metadata or {}).items()}
            rows.append((path, meta.num_rows, meta.num_row_groups, *(keys.get(k) for k in KEYS), json.dumps(sorted(keys))))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
        names = ["path", "n_rows", "row_groups", "geo", "license", "attribution", "redistribution", "keys"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def footer_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_rows, row_groups, geo, license, attribution, redistribution, keys) of each file."""
    return _files(spark, path).mapInArrow(_inventory, "path string, n_rows long, row_groups int, geo string, license string, attribution string, redistribution string, keys string")


def declared(spark: SparkSession, path: str) -> dict[str, str | None]:
    """What all files below a path declare alike: geo, license, attribution, redistribution. Files that differ are no dataset (ValueError)."""
    found = footer_inventory(spark, path).select(*KEYS).distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"files differ in their footers: {path}")
    return found[0].asDict() if found else dict.fromkeys(KEYS)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            meta = _footer(path, content)
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for c in range(group.num_columns):
                    column = group.column(c)
                    s = column.statistics
                    known = s is not None and s.has_min_max and isinstance(s.min, (int, float)) and not isinstance(s.min, bool)
                    lo, hi = (float(s.min), float(s.max)) if known else (None, None)
                    whole = known and isinstance(s.min, int)
                    rows.append((path, g, group.num_rows, column.path_in_schema, lo, hi, s.min if whole else None, s.max if whole else None, s.null_count if s is not None and s.has_null_count else None, column.total_compressed_size))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["path", "row_group", "n_rows", "column", "min", "max", "min_long", "max_long", "nulls", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def row_group_bounds(spark: SparkSession, path: str, identity: str = "id", covering: str = "bbox") -> DataFrame:
    """(file, row_group, n_rows, id_lo, id_hi, g_xmin, g_ymin, g_xmax, g_ymax, bytes) of each row group, from the footers' statistics alone."""
    stats = row_group_statistics(spark, path)

    def one(column: str, value: str, by=F.max):
        return by(F.when(F.col("column") == column, F.col(value)))

    return stats.groupBy(F.col("path").alias("file"), "row_group").agg(
        F.max("n_rows").alias("n_rows"),
        one(identity, "min_long").alias("id_lo"),
        one(identity, "max_long").alias("id_hi"),
        one(f"{covering}.xmin", "min").alias("g_xmin"),
        one(f"{covering}.ymin", "min").alias("g_ymin"),
        one(f"{covering}.xmax", "max").alias("g_xmax"),
        one(f"{covering}.ymax", "max").alias("g_ymax"),
        F.sum("bytes").alias("bytes"),
    )


def row_group_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_group, n_rows, column, min, max, min_long, max_long, nulls, bytes) of each column of each row group; null where the footer has none."""
    return _files(spark, path).mapInArrow(_statistics, "path string, row_group int, n_rows long, column string, min double, max double, min_long long, max_long long, nulls long, bytes long")
