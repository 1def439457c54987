"""Running a stream over what there is, to a table that all executors see."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.operators.selection import Box, bbox_intersects, extent
from plotwise.storage import shared_folder
from plotwise.sources.audit import parse_audit


def stream_of(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A file stream of Parquet rows, with the schema that the files have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _rocks(spark: SparkSession, wanted: bool) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which stateful processors need."""
    before = spark.conf.get(_STORE)
    try:
        if wanted:
            spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        yield
    finally:
        spark.conf.set(_STORE, before)


def run_append(stream: DataFrame, name: str, rocks: bool = False, progress: list | None = None) -> DataFrame:
    """All available input, appended to Parquet with exactly-once commits; the rows written. progress: takes the reports of the micro-batches."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, name)
    with _rocks(spark, rocks):
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
        query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """The last state of a complete-mode aggregate: each micro-batch replaces the table."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, name)

    def replace(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows")

    query = stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def tail_audit(spark: SparkSession, path: str) -> DataFrame:
    """A stream of audit records from text files; corrupt lines stay, with their reason."""
    lines = spark.readStream.text(path).select(F.lit(None).cast("long").alias("line_no"), "value")
    return parse_audit(lines)


def pair_streams(records: DataFrame, bound: str = "10 minutes") -> DataFrame:
    """(attempt, state): intents with their outcome within the bound, and intents that none came for once the watermark has passed it. records: attempt, phase, at."""
    intents = records.where("phase = 'intent'").select(F.col("attempt").alias("attempt"), F.col("at").alias("intent_at")).withWatermark("intent_at", bound)
    outcomes = records.where("phase = 'outcome'").select(F.col("attempt").alias("o_attempt"), F.col("at").alias("outcome_at")).withWatermark("outcome_at", bound)
    met = (F.col("attempt") == F.col("o_attempt")) & (F.col("outcome_at") >= F.col("intent_at")) & (F.col("outcome_at") <= F.col("intent_at") + F.expr(f"INTERVAL {bound}"))
    return intents.join(outcomes, met, "leftOuter").select("attempt", F.when(F.col("o_attempt").isNull(), "orphan-intent").otherwise("pair").alias("state"))


def once(batches: DataFrame, keys: list[str], clock: str, bound: str) -> DataFrame:
    """Batches without those whose keys came before within the bound."""
    return batches.withWatermark(clock, bound).dropDuplicatesWithinWatermark(keys)


def viewport_extent(features: DataFrame, view: Box, predicate: str) -> DataFrame:
    """Running count and extent of the features that meet a viewport and a predicate."""
    box = [F.col(f"bbox.{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    return features.where(predicate).where(bbox_intersects(view)).agg(F.count("*").alias("n"), *extent(*box))
