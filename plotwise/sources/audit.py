"""The audit log: JSON lines, read tolerantly; a corrupt line is kept and labelled, never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "audit-record/1"
FIELDS = (
    "schema string, attempt string, phase string, at string, operation string, class string, reversibility string, principal_kind string, principal_name string, source_name string,"
    " source_content_hash string, destination string, style_hash string, outcome string, error_kind string, grantor_kind string, grantor_name string, grant_lifetime_s long,"
    " grant_remaining_s long, approval_route string, approval string, operation_digest string, manifest_hash string, rows long, partitions long"
)


def parse_audit(lines: DataFrame) -> DataFrame:
    """lines (line_no, value, and what else there is) with the record's fields and `corrupt_reason`, null where the line is good; blank lines are left out.

    approval is the older name of approval_route."""
    record = F.from_json("value", f"{FIELDS}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    parsed = lines.where(F.trim("value") != "").select("*", record.alias("r"))
    r = F.col("r")
    reason = (
        F.when(r.isNull() | r["_broken"].isNotNull(), "not-json")
        .when(~r["schema"].eqNullSafe(F.lit(SCHEMA)), "wrong-schema")
        .when(r["attempt"].isNull(), "no-attempt")
        .when(~F.coalesce(r["phase"].isin("intent", "outcome"), F.lit(False)), "bad-phase")
        .when((r["phase"] == "intent") & (r["at"].isNull() | r["destination"].isNull()), "intent-missing-fields")
        .when((r["phase"] == "outcome") & (r["at"].isNull() | r["outcome"].isNull()), "outcome-missing-fields")
    )
    fields = [F.coalesce(r["approval_route"], r["approval"]).alias("approval_route") if f == "approval_route" else r[f].alias(f) for f in (x.split()[0] for x in FIELDS.split(",")) if f != "approval"]
    return parsed.select(*lines.columns, reason.alias("corrupt_reason"), *fields)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files' lines, numbered from 1 in their file. A large file is read by many tasks.

    Spark cuts files into blocks and tells each row its block's first byte, so a line's number is its place in its block and the lines of the blocks
    before.  Blocks are counted in a pass of their own, a row each; no line is moved for it.  Lines end with \\n, or \\r\\n, as in any text file."""
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("_at")
    )
    blocks = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(starts, ["file", "_block"]).select("file", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "value")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, ...) of audit files."""
    return parse_audit(numbered_lines(spark, path))
