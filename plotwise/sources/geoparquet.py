"""GeoParquet files with their footer keys: written by tasks, since Spark's own writer can't set key-value metadata.

Each task writes the files of its partition, in the order of its rows, through Arrow's file systems, under names that no other attempt has;
what it gives back names the files that count.  The driver drops what a lost attempt left, and renames the folder last."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from plotwise.sources.footers import file_system
from plotwise.storage import keep_only, move, passing

_FILES = "file string, n_rows long, bytes long, content_hash string"


def write_files(df: DataFrame, dest: str, keys: dict[str, str], rows_per_file: int = 8192, rows_per_group: int = 8192) -> DataFrame:
    """Write the rows, partition by partition as they are ordered, and give back (file, n_rows, bytes, content_hash). The destination must be new.

    keys: footer metadata of every file, such as `geo` and `license`."""
    spark = df.sparkSession
    staged = passing(spark, f"{dest.rstrip('/')}.staged-{uuid.uuid4().hex}")
    schema = to_arrow_schema(df.schema).with_metadata({k.encode(): v.encode() for k, v in keys.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = file_system(staged)
        files.create_dir(root, recursive=True)
        done: list[tuple] = []
        rest, held = [], 0

        def write(rows: pa.Table) -> None:
            name = f"part-{task.partitionId():05d}-{len(done):05d}-{task.taskAttemptId()}.parquet"
            sink = pa.BufferOutputStream()
            pq.write_table(rows, sink, row_group_size=rows_per_group, compression="snappy")
            body = sink.getvalue()
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(body)
            done.append((name, rows.num_rows, body.size, hashlib.sha256(body).hexdigest()))

        for batch in batches:
            rest.append(batch.cast(schema))
            held += batch.num_rows
            if held >= rows_per_file:
                rows = pa.Table.from_batches(rest, schema)
                while rows.num_rows >= rows_per_file:
                    write(rows.slice(0, rows_per_file))
                    rows = rows.slice(rows_per_file)
                rest, held = rows.to_batches(), rows.num_rows
        if held:
            write(pa.Table.from_batches(rest, schema))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=["file", "n_rows", "bytes", "content_hash"])

    written = df.mapInArrow(run, _FILES).toArrow()  # a row a file
    keep_only(spark, staged, set(written.column("file").to_pylist()))
    move(spark, staged, dest)
    return spark.createDataFrame(written)


def geo_key(crs: str | None, column: str = "geometry", covering: str | None = "bbox") -> str:
    """The `geo` metadata of polygon files: WKB, a covering column if there is one. crs: PROJJSON text, or null for none given."""
    import json

    own: dict = {"encoding": "WKB", "geometry_types": ["Polygon"]}
    if crs is not None:
        own["crs"] = json.loads(crs)
    if covering:
        own["covering"] = {"bbox": {side: [covering, side] for side in ("xmin", "ymin", "xmax", "ymax")}}
    return json.dumps({"version": "1.1.0", "primary_column": column, "columns": {column: own}}, sort_keys=True)


def carried_keys(spark: SparkSession, path: str) -> dict[str, str]:
    """The footer keys that a copy of these files must carry."""
    from plotwise.sources.footers import declared

    return {k: v for k, v in declared(spark, path).items() if v is not None}
