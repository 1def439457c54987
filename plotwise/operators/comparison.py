"""Comparing tables row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_outside(part: DataFrame, whole: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the part that the whole has not, value by value (null equals null)."""
    other = whole.select(*(F.col(c).alias(f"_{c}") for c in part.columns))
    same = F.col(key) == F.col(f"_{key}")
    for c in part.columns:
        if c != key:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return part.join(other, same, "left_anti")


def differences(a: DataFrame, b: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, state) where two tables differ: only_a, only_b, or changed."""
    left = a.select(key, F.struct(*values).alias("a"))
    right = b.select(F.col(key).alias("_key"), F.struct(*values).alias("b"))
    both = left.join(right, left[key] == right["_key"], "full_outer")
    state = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(F.coalesce(key, "_key").alias(key), state.alias("state")).where("state IS NOT NULL")
