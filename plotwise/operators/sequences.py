"""Order-dependent work: rows are range-partitioned by their key, sorted and written once; what crosses ranges is one small row a range.

Ranges come from Spark's own sample of the keys, so they hold about as many rows each, whatever the keys are: dense, sparse or clustered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.storage import saved, stored_bytes

_BITS = 33  # of monotonically_increasing_id, for the place in a partition


#: Stored bytes that a range stands for.
RANGE_BYTES = 64 << 20


def range_count(df: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """By the bytes read, so that a range and its task stay as they are while the data grow; small tables are spread over the cores there are."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-stored_bytes(df) // range_bytes))


#: Stored bytes that a task of heavy work stands for.
HEAVY_BYTES = 256 << 10


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key to tasks enough for work that is heavy for their bytes: a small file comes as one task, and Spark would join small ones."""
    return df.repartition(range_count(df, HEAVY_BYTES), key)


def in_ranges(df: DataFrame, key: Sequence[str], partitions: int) -> DataFrame:
    """The rows in order, with _range (the number of their range) and _place (from 0 in it)."""
    ordered = df.repartitionByRange(partitions, *key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id())
    at = F.col("_at")
    return ordered.select(*df.columns, F.shiftright(at, _BITS).alias("_range"), at.bitwiseAND(F.lit((1 << _BITS) - 1)).alias("_place"))


def placed(df: DataFrame, key: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The rows in order, with _range (the number of their range) and _place (from 0 in it), in the shared folder."""
    return saved(in_ranges(df, key, partitions or range_count(df)), "ranges")


def offsets(counts: DataFrame, by: str, n: str, name: str) -> DataFrame:
    """Running sums before each range, in order; one row a range comes in, so one task may read them."""
    before = F.sum(n).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(by, F.coalesce(before, F.lit(0)).alias(name))


def global_ordinal(df: DataFrame, key: str | Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """The rows with their ordinal, from 0, in the order of the key; rows of one key are numbered in any order."""
    rows = placed(df, [key] if isinstance(key, str) else list(key), partitions)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.broadcast(offsets(counts, "_range", "_n", "_before"))  # a row a partition
    return rows.join(before, "_range").select(*df.columns, (F.col("_place") + F.col("_before")).alias(name))


def islands(df: DataFrame, key: str = "id", partitions: int | None = None) -> DataFrame:
    """(lo, hi) of the maximal runs of consecutive distinct integers: within a run, a number and its ordinal grow alike."""
    rows = global_ordinal(df.select(key).distinct(), key, "_k", partitions)
    return rows.groupBy((F.col(key) - F.col("_k")).alias("_run")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).select("lo", "hi")


def consecutive_groups(df: DataFrame, partition: Sequence[str], order: Sequence[str], same: Sequence[str], name: str = "group_no") -> DataFrame:
    """Rows numbered by group: a new group begins where any of the `same` columns changes within a partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed: Column = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("_new", F.when(first | changed, 1).otherwise(0)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
