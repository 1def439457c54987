"""Queries on layout: quantising, curves, orders, row groups, runs of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.functions.curve import centroid, hilbert, hilbert_cell, quantize
from plotwise.operators.layout import clamped, group_admissibility, group_selection, layout_facts, layout_key, merge_contiguous, rewrite_layout
from plotwise.operators.sequences import global_ordinal, islands
from plotwise.plans.catalog import query
from plotwise.plans.fixtures import E0, N0, PARCELS_SQL, PITCH, grid_cols, parcels
from plotwise.storage import shared_folder


def declared_extent(cols: int) -> tuple[float, float, float, float]:
    """A little less than the whole grid, so that the last column and row are clamped."""
    return (E0, N0, E0 + (cols - 1) * PITCH, N0 + (cols - 1) * PITCH)


_QUANT_SQL = f"""WITH RECURSIVE {PARCELS_SQL}, t AS (SELECT id, ((xmin + xmax) / 2 - 2600000) / ((cols - 1) * 40.0::DOUBLE) * 65535 AS sx, ((ymin + ymax) / 2 - 1200000) / ((cols - 1) * 40.0::DOUBLE) * 65535 AS sy FROM p CROSS JOIN g),
q AS (SELECT id, CAST(floor(greatest(0, least(65535, sx)) + 0.5) AS BIGINT) AS x, CAST(floor(greatest(0, least(65535, sy)) + 0.5) AS BIGINT) AS y, sx < 0 OR sx > 65535 OR sy < 0 OR sy > 65535 AS clamped FROM t),
h(id, x, y, s, d) AS (SELECT id, x, y, 32768::BIGINT, 0::BIGINT FROM q UNION ALL
  SELECT id, CASE WHEN (y & s) > 0 THEN x WHEN (x & s) > 0 THEN 65535 - y ELSE y END, CASE WHEN (y & s) > 0 THEN y WHEN (x & s) > 0 THEN 65535 - x ELSE x END, s // 2,
    d + s * s * CASE WHEN (x & s) > 0 AND (y & s) > 0 THEN 2 WHEN (x & s) > 0 THEN 3 WHEN (y & s) > 0 THEN 1 ELSE 0 END FROM h WHERE s > 0),
k AS (SELECT id, d AS key FROM h WHERE s = 0)"""


@query("quantized_cells", f"{_QUANT_SQL} SELECT id, x, y, clamped FROM q")
def quantized_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = grid_cols(spark, sf_dir)
    ext = declared_extent(cols)
    cx, cy = centroid()
    return parcels(spark, sf_dir, cols).select("id", quantize(cx, ext[0], ext[2])[0].alias("x"), quantize(cy, ext[1], ext[3])[0].alias("y"), clamped(ext).alias("clamped"))


@query("hilbert_key", f"{_QUANT_SQL} SELECT id, key FROM k")
def hilbert_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = grid_cols(spark, sf_dir)
    return parcels(spark, sf_dir, cols).select("id", layout_key("hilbert16", extent=declared_extent(cols)).alias("key"))


@query("hilbert_inverse", "SELECT o_orderkey AS id, (o_orderkey * 7919 + o_custkey) % 65536 AS x, (o_orderkey * 104729) % 65536 AS y FROM orders")
def hilbert_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back: cells put on the curve and taken off it are the same cells."""
    from plotwise.plans.fixtures import table

    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 7919 + F.col("o_custkey")) % 65536).alias("x"), ((F.col("o_orderkey") * 104729) % 65536).alias("y"))
    return cells.select("id", hilbert_cell(hilbert(F.col("x"), F.col("y"))).alias("c")).select("id", "c.x", "c.y")


@query("shuffled_order", "SELECT o_orderkey AS id, sha256(CAST(o_orderkey AS VARCHAR)) AS key FROM orders")
def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in the shuffled order."""
    return parcels(spark, sf_dir).select("id", layout_key("shuffled").alias("key")).orderBy("key", "id")


@query("shuffled_order_all", "SELECT o_orderkey AS id, sha256(CAST(o_orderkey AS VARCHAR)) AS key, row_number() OVER (ORDER BY key, id) - 1 AS ordinal FROM orders")
def shuffled_order_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole shuffled order as ordinals."""
    return global_ordinal(parcels(spark, sf_dir).select("id", layout_key("shuffled").alias("key")), ["key", "id"], "ordinal")


@query("layout_facts", f"{_QUANT_SQL} SELECT count(*) AS n_rows, (SELECT count(DISTINCT key) FROM k) AS distinct_keys, count(*) FILTER (clamped)::BIGINT AS clamped, ceil(count(*) / 1000.0)::BIGINT AS row_groups FROM q")
def layout_facts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = grid_cols(spark, sf_dir)
    return layout_facts(parcels(spark, sf_dir, cols), declared_extent(cols), 1000)


@query("layout_rewrite", f"WITH {PARCELS_SQL} SELECT id, zone, value, xmin, ymin, xmax, ymax FROM p")
def layout_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read back from a Hilbert-clustered rewrite: the same rows."""
    cols = grid_cols(spark, sf_dir)
    written = rewrite_layout(parcels(spark, sf_dir, cols), shared_folder(spark, "layout"), "hilbert16", declared_extent(cols), 4096)
    return written.select("id", "zone", "value", "bbox.*")


@query(
    "layouts_equal",
    f"WITH {PARCELS_SQL} SELECT id, CASE WHEN id % 101 = 7 THEN 'only_a' WHEN id % 101 = 8 THEN 'only_b' ELSE 'changed' END AS state FROM p WHERE id % 101 IN (7, 8) OR id % 97 = 5 UNION ALL SELECT -1, 'rows alike: ' || count(*) FROM p WHERE id % 101 NOT IN (7, 8) AND id % 97 <> 5",
)
def layouts_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Hilbert layout against a shuffled one with edits: the rows that differ, and how many don't."""
    from plotwise.operators.comparison import differences

    cols = grid_cols(spark, sf_dir)
    features = parcels(spark, sf_dir, cols)
    k = F.col("id")
    a = rewrite_layout(features.where(k % 101 != 8), shared_folder(spark, "layout"), "hilbert16", declared_extent(cols))
    edited = features.where(k % 101 != 7).withColumn("value", F.when(k % 97 == 5, F.col("value") + 1).otherwise(F.col("value")))
    found = differences(a, rewrite_layout(edited, shared_folder(spark, "layout"), "shuffled"), "id", ["zone", "value", "bbox"])
    alike = features.count() - found.count()
    return found.unionByName(spark.createDataFrame([(-1, f"rows alike: {alike}")], "id long, state string"))


def groups_of(features: DataFrame, rows: int = 1000) -> DataFrame:
    """Row-group statistics of the identity layout, computed from the rows: (file, row_group, rows, id_lo, id_hi, g_xmin, g_ymin, g_xmax, g_ymax)."""
    keyed = features.withColumn("row_group", F.floor(F.col("id") / rows)).withColumn("file", F.concat(F.lit("part-"), F.floor(F.col("row_group") / 4)))
    return keyed.groupBy("file", "row_group").agg(
        F.count("*").alias("n_rows"),
        F.min("id").alias("id_lo"),
        F.max("id").alias("id_hi"),
        F.min("bbox.xmin").alias("g_xmin"),
        F.min("bbox.ymin").alias("g_ymin"),
        F.max("bbox.xmax").alias("g_xmax"),
        F.max("bbox.ymax").alias("g_ymax"),
    )


_GROUPS_SQL = f"""{PARCELS_SQL}, rg AS (SELECT 'part-' || CAST(id // 1000 // 4 AS VARCHAR) AS file, id // 1000 AS row_group, count(*) AS n_rows, min(id) AS id_lo, max(id) AS id_hi, min(xmin) AS g_xmin, min(ymin) AS g_ymin, max(xmax) AS g_xmax, max(ymax) AS g_ymax FROM p GROUP BY ALL)"""


@query("row_group_statistics", f"WITH {_GROUPS_SQL} SELECT * FROM rg")
def row_group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_of(parcels(spark, sf_dir))


_VIEWPORT_TABLE_SQL = "vw AS (SELECT s_suppkey AS view_id, 2600000 + (s_suppkey * 7 % cols) * 40 + 20 - 40 * (1 + s_suppkey % 5) AS xmin, 1200000 + (s_suppkey * 13 % cols) * 40 + 20 - 40 * (1 + s_suppkey % 5) AS ymin, 2600000 + (s_suppkey * 7 % cols) * 40 + 20 + 40 * (1 + s_suppkey % 5) AS xmax, 1200000 + (s_suppkey * 13 % cols) * 40 + 20 + 40 * (1 + s_suppkey % 5) AS ymax FROM supplier CROSS JOIN g)"


def view_table(spark: SparkSession, sf_dir: str, cols: int) -> DataFrame:
    """A viewport for each supplier, centred on a parcel."""
    from plotwise.plans.fixtures import table

    k = F.col("s_suppkey")
    half = (1 + k % 5) * PITCH
    cx, cy = F.lit(E0) + (k * 7 % cols) * PITCH + 20, F.lit(N0) + (k * 13 % cols) * PITCH + 20
    return table(spark, sf_dir, "supplier").select(k.alias("view_id"), (cx - half).alias("xmin"), (cy - half).alias("ymin"), (cx + half).alias("xmax"), (cy + half).alias("ymax"))


@query(
    "row_group_selection",
    f"""WITH {_GROUPS_SQL}, {_VIEWPORT_TABLE_SQL}, c AS (SELECT view_id, count(*) FILTER (g_xmin <= xmax AND g_xmax >= xmin AND g_ymin <= ymax AND g_ymax >= ymin) AS kept, count(*) AS total FROM rg CROSS JOIN vw GROUP BY view_id)
    SELECT *, CASE WHEN kept = 0 THEN 'exclude-all' WHEN kept = total THEN 'kept-all' WHEN kept > 4096 THEN 'too-fragmented' ELSE 'pruned' END AS plan FROM c""",
)
def row_group_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = grid_cols(spark, sf_dir)
    return group_selection(groups_of(parcels(spark, sf_dir, cols)), view_table(spark, sf_dir, cols))


@query(
    "row_group_admissibility",
    f"""WITH {_GROUPS_SQL}, s AS (SELECT file, row_group, CASE WHEN row_group % 7 = 3 THEN NULL ELSE id_lo END AS id_lo, CASE WHEN row_group % 5 = 2 THEN id_hi + 1500 ELSE id_hi END AS id_hi FROM rg),
    j AS (SELECT file, row_group, id_lo, id_hi, lag(id_hi) OVER (PARTITION BY file ORDER BY row_group) AS b FROM s),
    r AS (SELECT file, row_group, CASE WHEN id_lo IS NULL OR id_hi IS NULL THEN 'statistics-absent' WHEN id_lo > id_hi THEN 'unordered' WHEN id_lo <= b THEN CASE WHEN id_hi < b THEN 'unordered' ELSE 'overlapping' END END AS reason FROM j)
    SELECT file, arg_min(reason, row_group) FILTER (reason IS NOT NULL) AS refusal, count(*) AS row_groups FROM r GROUP BY file""",
)
def row_group_admissibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = groups_of(parcels(spark, sf_dir))
    spoilt = groups.withColumn("id_lo", F.when(F.col("row_group") % 7 != 3, F.col("id_lo"))).withColumn("id_hi", F.when(F.col("row_group") % 5 == 2, F.col("id_hi") + 1500).otherwise(F.col("id_hi")))
    return group_admissibility(spoilt)


@query(
    "merged_row_groups",
    f"""WITH {_GROUPS_SQL}, k AS (SELECT * FROM rg WHERE row_group % 3 <> 1), m AS (SELECT *, CASE WHEN id_lo = lag(id_hi) OVER (PARTITION BY file ORDER BY id_lo) + 1 THEN 0 ELSE 1 END AS fresh FROM k),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY id_lo) AS run FROM m) SELECT file, min(id_lo) AS id_lo, max(id_hi) AS id_hi, count(*) AS n_groups FROM r GROUP BY file, run""",
)
def merged_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_contiguous(groups_of(parcels(spark, sf_dir)).where("row_group % 3 <> 1"))


@query(
    "id_runs",
    f"WITH {PARCELS_SQL}, u AS (SELECT id, id - row_number() OVER (ORDER BY id) AS run FROM p WHERE zone = '1-URGENT' OR id BETWEEN 4000 AND 9000) SELECT min(id) AS lo, max(id) AS hi FROM u GROUP BY run",
)
def id_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(parcels(spark, sf_dir).where("zone = '1-URGENT' OR id BETWEEN 4000 AND 9000").select("id"))
