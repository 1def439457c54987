"""Clustering features along a curve, and writing them so that file statistics skip what a viewport doesn't meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from plotwise.functions.curve import centroid, hilbert, quantize
from plotwise.operators.selection import Box
from plotwise.operators.spatial_joins import bbox_join


def layout_key(order: str, identity: str = "id", extent: Box | None = None) -> Column:
    """The sort key of a declared order: source-identity, hilbert16 over the box centroids in a declared extent, or shuffled (by a hash of the id, never random)."""
    if order == "source-identity":
        return F.col(identity)
    if order == "shuffled":
        return F.sha2(F.col(identity).cast("string").cast("binary"), 256)
    if order == "hilbert16":
        if extent is None:
            raise ValueError("hilbert16 needs a declared extent")
        cx, cy = centroid()
        return hilbert(quantize(cx, extent[0], extent[2])[0], quantize(cy, extent[1], extent[3])[0])
    raise ValueError(f"no such order: {order}")


def clamped(extent: Box) -> Column:
    cx, cy = centroid()
    return quantize(cx, extent[0], extent[2])[1] | quantize(cy, extent[1], extent[3])[1]


def in_order(features: DataFrame, order: str, extent: Box | None = None, partitions: int | None = None, identity: str = "id") -> DataFrame:
    """The rows range-partitioned by a declared order and sorted in each partition: ordered as a whole, without a single task."""
    partitions = partitions or int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = features.withColumn("_key", layout_key(order, identity, extent))
    return keyed.repartitionByRange(partitions, "_key", identity).sortWithinPartitions("_key", identity).drop("_key")


def rewrite_layout(features: DataFrame, dest: str, order: str, extent: Box | None = None, rows_per_file: int = 8192, partitions: int | None = None, identity: str = "id") -> DataFrame:
    """Write the same rows in a declared order, so many rows a file, and give back what was written; refuses a destination that exists.

    A range shuffle on (key, id) and a sort in each partition order the whole without a single task; the rows that went in are counted as they
    are written, and the count of the files' footers must agree."""
    spark = features.sparkSession
    ordered = in_order(features, order, extent, partitions, identity)
    seen = Observation()
    ordered.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).option("compression", "snappy").parquet(dest)
    written = spark.read.parquet(dest)
    before, after = seen.get["n"], written.count()
    if before != after:
        raise ValueError(f"row_count_changed: {before} rows in, {after} written")
    return written


def layout_facts(features: DataFrame, extent: Box, rows_per_group: int) -> DataFrame:
    """One row: rows, distinct curve keys, rows outside the declared extent, row groups."""
    keyed = features.select(layout_key("hilbert16", extent=extent).alias("key"), clamped(extent).alias("clamped"))
    by_key = keyed.groupBy("key").agg(F.count("*").alias("n"), F.count_if("clamped").alias("c"))
    return by_key.agg(F.sum("n").alias("n_rows"), F.count("*").alias("distinct_keys"), F.sum("c").alias("clamped")).select("*", F.ceil(F.col("n_rows") / rows_per_group).cast("long").alias("row_groups"))


def group_selection(groups: DataFrame, views: DataFrame, max_ranges: int = 4096) -> DataFrame:
    """For each viewport how many row groups its envelope test keeps, and the plan's label. A group of unknown envelope is always kept.

    Groups and viewports meet on the levelled grid of bbox_join, so only those that are near each other are compared."""
    sides = ("xmin", "ymin", "xmax", "ymax")
    known = groups.where("g_xmin IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), *(F.col(f"g_{c}").alias(c) for c in sides))
    of_all = groups.agg(F.count("*").alias("n"), F.count_if(F.col("g_xmin").isNull()).alias("unknown"), F.count_if(F.col("id_lo").isNull()).alias("unbounded"), *(f(f"g_{c}").alias(c) for f, c in zip((F.min, F.min, F.max, F.max), sides, strict=True))).first()
    extent = tuple(of_all[c] if of_all[c] is not None else 0.0 for c in sides)
    met = bbox_join(known, views.select("view_id", *sides), extent).groupBy("view_id").agg(F.count("*").alias("met"))
    kept, total = F.coalesce("met", F.lit(0)) + of_all["unknown"], F.lit(of_all["n"])
    plan = (
        F.when(F.lit(of_all["unbounded"] > 0), "not-prunable")
        .when(kept == 0, "exclude-all")
        .when(kept == total, "kept-all")
        .when(kept > max_ranges, "too-fragmented")
        .otherwise("pruned")
    )
    return views.select("view_id").join(met, "view_id", "left").select("view_id", kept.alias("kept"), total.alias("total"), plan.alias("plan"))


def group_admissibility(groups: DataFrame) -> DataFrame:
    """(file, refusal) of each file: the first reason by ordinal why its row groups can't bound ids, or null."""
    w = Window.partitionBy("file").orderBy("row_group")
    before = F.lag("id_hi").over(w)
    reason = (
        F.when(F.col("id_lo").isNull() | F.col("id_hi").isNull(), "statistics-absent")
        .when(F.col("id_lo") > F.col("id_hi"), "unordered")
        .when(F.col("id_lo") <= before, F.when(F.col("id_hi") < before, "unordered").otherwise("overlapping"))
    )
    judged = groups.withColumn("reason", reason)
    return judged.groupBy("file").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("row_group"))).alias("refusal"), F.count("*").alias("row_groups"))


def merge_contiguous(groups: DataFrame) -> DataFrame:
    """(file, id_lo, id_hi, groups) with row groups of adjoining id ranges merged."""
    w = Window.partitionBy("file").orderBy("id_lo")
    new = F.when(F.col("id_lo") == F.lag("id_hi").over(w) + 1, 0).otherwise(1)
    marked = groups.withColumn("_new", new)
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_run", run).groupBy("file", "_run").agg(F.min("id_lo").alias("id_lo"), F.max("id_hi").alias("id_hi"), F.count("*").alias("n_groups")).drop("_run")
