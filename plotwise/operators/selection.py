"""Selecting features: covering-box viewport, predicate, projection, limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


def bbox_intersects(view: Box, bbox: str = "bbox") -> Column:
    """Closed-interval intersection of a covering box with a viewport; touching edges count. Plain comparisons, so that Parquet statistics prune."""
    xmin, ymin, xmax, ymax = (float(v) for v in view)
    return (F.col(f"{bbox}.xmin") <= xmax) & (F.col(f"{bbox}.xmax") >= xmin) & (F.col(f"{bbox}.ymin") <= ymax) & (F.col(f"{bbox}.ymax") >= ymin)


def select_features(features: DataFrame, view: Box | None = None, predicate: str | None = None, columns: Sequence[str] = (), identity: str = "id", limit: int | None = None) -> DataFrame:
    """Rows that meet the predicate and the viewport: identity first (as `id`), then the columns in the order declared."""
    if predicate is not None:
        features = features.where(F.expr(predicate))
    if view is not None:
        features = features.where(bbox_intersects(view))
    features = features.select(F.col(identity).alias("id"), *columns)
    return features if limit is None else features.limit(limit)


def extent(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> list[Column]:
    """Aggregates xmin, ymin, xmax, ymax over rows with finite bounds; all null where there is none."""
    inf = float("inf")
    finite = (F.abs(xmin) < inf) & (F.abs(ymin) < inf) & (F.abs(xmax) < inf) & (F.abs(ymax) < inf)  # NaN is no less than infinity: Spark orders it above
    return [
        F.min(F.when(finite, xmin)).alias("xmin"),
        F.min(F.when(finite, ymin)).alias("ymin"),
        F.max(F.when(finite, xmax)).alias("xmax"),
        F.max(F.when(finite, ymax)).alias("ymax"),
    ]
