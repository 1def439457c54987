"""Trace files (JSON lines) and trial artifacts (JSON documents), read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "kind string, trace_id string, label string, dataset string, physical_id string, name string, offset_nanos long, rows long, bytes long, millis double"
TRIALS = (
    "cell string, trials array<struct<rep:int, error:string, rows:long, wire_fold:string, filter_plan:struct<name:string>, cut_policy:string, first_batch_ms:double, total_ms:double, read_bytes:long, index_build_ms:double>>"
)


def read_traces(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The lines of trace files by kind: trace-key, event, span. A line that doesn't parse has no kind, and is under `broken`."""
    lines = spark.read.schema(f"{TRACE}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    columns = {"trace-key": ["trace_id", "label", "dataset", "physical_id"], "event": ["trace_id", "name", "offset_nanos", "rows", "bytes"], "span": ["trace_id", "name", "millis"]}
    found = {kind: lines.where(F.col("kind") == kind).select(*names) for kind, names in columns.items()}
    return found | {"broken": lines.where(F.col("_broken").isNotNull() | F.col("kind").isNull()).select("_broken")}


def read_trials(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row for each trial of artifact files: cell and the trial's fields. A file has one document, or an array of them; or one a line."""
    documents = spark.read.schema(TRIALS).option("multiLine", not lines).json(path)
    return documents.select("cell", F.explode("trials").alias("t")).select("cell", "t.*").withColumn("filter_plan", F.col("filter_plan.name"))
