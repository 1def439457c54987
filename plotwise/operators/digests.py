"""Digests of tables that don't depend on how they are cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LEVELS = 5


def set_digest(digests: DataFrame, width: int = 1024, key: str = "id", digest: str = "digest") -> DataFrame:
    """One row (n_rows, digest): SHA-256 over ascending (id, digest), as a tree: fixed id ranges are digested, then ranges of ranges, and so on.

    A range holds at most `width` distinct ids and a level 4096 ranges, and LEVELS levels cover all 64-bit ids, so no task gathers more, whatever
    the table's size."""
    leaf = F.concat_ws(":", F.col(key).cast("string"), F.col(digest))

    def level(df: DataFrame, by, order: str, value: str, n: str) -> DataFrame:
        parts = F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value])
        return df.groupBy(by.alias("k")).agg(F.sum(n).alias("n"), F.sha2(F.concat_ws("|", parts).cast("binary"), 256).alias("d"))

    rows = digests.select(F.col(key), leaf.alias("leaf"), F.lit(1).alias("one"))
    tree, k = level(rows, F.floor(F.col(key) / width), key, "leaf", "one"), "k"
    for up in [*[F.floor(F.col(k) / 4096)] * LEVELS, F.lit(0)]:  # at the end ranges -1 and 0 are left
        tree = level(tree.select("k", "n", F.concat_ws(":", "k", "d").alias("leaf")), up, "k", "leaf", "n")
    return tree.select(F.col("n").alias("n_rows"), F.col("d").alias("digest"))
