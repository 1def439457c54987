"""Deterministic features in parallel: everything about a feature is a function of the seed and its id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The category of a feature is a mix of (seed, id) modulo 5; the fifth is null.
CATEGORIES = ("residential", "industrial", "agricultural", "civic")
MIX_STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def category_numbers(ids: np.ndarray, seed: int) -> np.ndarray:
    """0 to 4 for each id, with 64-bit wrapping arithmetic."""
    z = np.uint64(seed) + ids.astype(np.uint64) * np.uint64(MIX_STEP)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    z ^= z >> np.uint64(31)
    return (z % np.uint64(5)).astype(np.int64)


def categorize(df: DataFrame, seed: int, id_column: str = "id") -> DataFrame:
    """(id, category) of a table's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*CATEGORIES, None], object)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[category_numbers(batch.column(0).to_numpy(), seed)], pa.string())], names=["id", "category"])

    return df.select(F.col(id_column).cast("long").alias("id")).mapInArrow(run, "id long, category string")


def generate_features(spark: SparkSession, n: int, seed: int, e0: float = 2600000.0, n0: float = 1200000.0, pitch: int = 40, hole_every: int = 7) -> DataFrame:
    """(id, bbox, vertices, hole) of n parcels on a square grid: vertex counts from 4 to 28 by a hash of the id."""
    cols = int(np.ceil(np.sqrt(n)))
    k = F.col("id")
    cx, cy = F.lit(e0) + (k % cols) * pitch + pitch / 2, F.lit(n0) + F.expr(f"id div {cols}") * pitch + pitch / 2
    half = pitch * 0.4
    box = F.struct((cx - half).alias("xmin"), (cy - half).alias("ymin"), (cx + half).alias("xmax"), (cy + half).alias("ymax"))
    return spark.range(n).select("id", box.alias("bbox"), (4 + F.pmod(F.xxhash64(F.lit(seed), k), F.lit(25))).cast("int").alias("vertices"), (k % hole_every == 0).alias("hole"))
