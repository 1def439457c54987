"""Feature tables derived from the driver's tables, each as a DataFrame and as the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

E0, N0, PITCH, HALF = 2600000.0, 1200000.0, 40, 16.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_cols(spark: SparkSession, sf_dir: str) -> int:
    """Columns of the square grid that holds all orders: ceil(sqrt(n)); n is a footer count."""
    n = table(spark, sf_dir, "orders").count()
    return int(ceil_sqrt(n))


def ceil_sqrt(n: int) -> int:
    from math import isqrt

    r = isqrt(n)
    return r if r * r == n else r + 1


def parcels(spark: SparkSession, sf_dir: str, cols: int | None = None) -> DataFrame:
    """(id, zone, value, bbox): one square parcel an order, on a grid of pitch 40."""
    cols = cols or grid_cols(spark, sf_dir)
    cx = F.lit(E0) + (F.col("o_orderkey") % cols) * PITCH + 20
    cy = F.lit(N0) + F.expr(f"o_orderkey div {cols}") * PITCH + 20
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("zone"),
        F.col("o_totalprice").alias("value"),
        F.struct((cx - HALF).alias("xmin"), (cy - HALF).alias("ymin"), (cx + HALF).alias("xmax"), (cy + HALF).alias("ymax")).alias("bbox"),
    )


#: Common table expressions: `g` has the grid's columns, `p` the parcels with flat bounds.
PARCELS_SQL = """g AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS cols FROM orders),
p AS (SELECT o_orderkey AS id, nullif(o_orderpriority, '4-NOT SPECIFIED') AS zone, o_totalprice AS value,
        2600000.0::DOUBLE + (o_orderkey % cols) * 40 + 20 - 16 AS xmin, 1200000.0::DOUBLE + (o_orderkey // cols) * 40 + 20 - 16 AS ymin,
        2600000.0::DOUBLE + (o_orderkey % cols) * 40 + 20 + 16 AS xmax, 1200000.0::DOUBLE + (o_orderkey // cols) * 40 + 20 + 16 AS ymax
      FROM orders CROSS JOIN g)"""


def viewports(cols: int) -> dict[str, tuple[float, float, float, float] | None]:
    """The four standing viewports of a grid; edges fall on cell centres."""

    def edge(k: int) -> float:
        return float((cols // k) * PITCH + 20)

    top = N0 + (cols - 1) * PITCH + 20
    return {
        "whole": None,
        "near-quarter": (E0, N0, E0 + edge(2), N0 + edge(2)),
        "far-quarter": (E0, top - edge(2), E0 + edge(2), top),
        "1-64": (E0, N0, E0 + edge(8), N0 + edge(8)),
    }
