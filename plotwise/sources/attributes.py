"""Attribute tables in CSV files, read with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plotwise.storage import saved

BROKEN = "_broken"


def read_attributes(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, those that don't as they are read, with the line under `_broken`).

    Files have a header with the schema's names in its order (Spark refuses others), quotes doubled inside quotes, and no line breaks within values, so
    that they can be split. A value that isn't of its type and a row of too few or too many values break the row; an empty value is null. Files are parsed
    once, all columns of them, and what is read is written to the shared folder: Spark doesn't answer queries about broken lines alone from raw files."""
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    options = {"header": True, "enforceSchema": False, "columnPruning": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "escape": '"'}
    lines = saved(spark.read.schema(StructType([*kinds.fields]).add(BROKEN, "string")).options(**options).csv(path), "attributes")
    return lines.where(F.col(BROKEN).isNull()).select(kinds.names), lines.where(F.col(BROKEN).isNotNull())
